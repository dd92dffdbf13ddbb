"""No streaming operators: every capability of this engine is a whole-file batch job.

Re-running a batch after new files arrive is cheap because
``tidemark.sources.model_store.refit_changed`` refits only the series whose
content fingerprint changed.
"""
