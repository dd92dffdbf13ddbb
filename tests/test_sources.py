"""Source layer on small CSV fixtures."""

import warnings
from datetime import date

import pytest

from tidemark import config as cfg
from tidemark.sources import platform_csv as P

BING = ",CampaignId,TimePeriod,Revenue,Spend,Clicks,CampaignType,CampaignName\n"
META = ",campaign_id,date_start,spend,conversion,campaign_name\n"
GOOGLE = ",campaign_id,segments_date,metrics_cost_micros,metrics_conversions_value,campaign_advertising_channel_type,campaign_name\n"


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


@pytest.fixture
def canonical(tmp_path):
    write(tmp_path, "bing_campaign_stats.csv", BING
          + "0,1,2024-01-01,10.5,2.25,3,Search,Alpha\n1,1,2024-01-02,-4,,3,Search,\n")
    write(tmp_path, "meta_ads_campaign_stats.csv", META
          + "0,7,2024-01-01,1.5,20,Prospecting_DPA\n1,8,2024-01-03,\"1,234\",30,Generic\n")
    write(tmp_path, "google_ads_campaign_stats.csv", GOOGLE
          + "0,9,2024-01-01,2500000,40,SEARCH,Alpha\n1,9,2024-01-02,1234567,50,VIDEO,Beta\n")
    return tmp_path


def rows(df):
    return sorted(tuple(r) for r in df.selectExpr(
        "channel", "campaign_type", "campaign_name", "ds", "double(revenue)", "double(spend)").collect())


def test_canonical_files(spark, canonical):
    assert rows(P.load_all(spark, str(canonical))) == sorted([
        ("bing", "Search", "Alpha", date(2024, 1, 1), 10.5, 2.25),
        ("bing", "Search", "nan", date(2024, 1, 2), 0.0, 0.0),
        ("meta", "Prospecting", "Prospecting_DPA", date(2024, 1, 1), 20.0, 1.5),
        ("meta", "Generic", "Generic", date(2024, 1, 3), 30.0, 0.0),
        ("google", "SEARCH", "Alpha", date(2024, 1, 1), 40.0, 2.5),
        ("google", "VIDEO", "Beta", date(2024, 1, 2), 50.0, 1.234567),
    ])


def test_discovery_prefers_exact_then_first_sorted_name(spark, tmp_path):
    write(tmp_path, "bing_z.csv", BING)
    write(tmp_path, "bing_a.csv", BING)
    write(tmp_path, "facebook_export.csv", META)
    write(tmp_path, "google_ads_campaign_stats.csv", GOOGLE)
    write(tmp_path, "google_a.csv", GOOGLE)
    write(tmp_path, "notes.txt", "x")
    found = {r["channel"]: (r["source_name"], r["matched_by"])
             for r in P.discover_sources(spark, str(tmp_path)).collect()}
    assert found == {"bing": ("bing_a.csv", "pattern"), "meta": ("facebook_export.csv", "pattern"),
                     "google": ("google_ads_campaign_stats.csv", "exact")}


def test_header_aliases_and_case_variants(spark, tmp_path):
    write(tmp_path, "bing.csv", "revenue,Revenue,Date,amount_spent,campaign\n1,2,2024-01-01,3,X\n")
    assert rows(P.load_platform(spark, str(tmp_path), "bing")) == [
        ("bing", "unknown", "X", date(2024, 1, 1), 2.0, 3.0)]


def test_alias_order_beats_column_order():
    assert P.pick(["sales", "conversion", "revenue"], cfg.REVENUE_ALIASES) == "revenue"
    assert P.pick(["other"], cfg.REVENUE_ALIASES) is None


def test_index_column_only_when_blank(spark, tmp_path):
    write(tmp_path, "bing.csv", "date,Revenue,Spend\n2024-01-01,1,2\n")
    assert rows(P.load_platform(spark, str(tmp_path), "bing")) == [
        ("bing", "unknown", "unknown", date(2024, 1, 1), 1.0, 2.0)]
    with pytest.warns(UserWarning, match="date"):
        assert P.load_platform(spark, str(tmp_path), "bing", legacy_index=True) is None


@pytest.mark.parametrize("costs, divided", [
    ([10_000, 10_000], False), ([10_001, 10_001], True), ([9_000, 11_000], False),
    ([9_000, 11_001], True), ([0, 0, 20_000], False), ([0, 20_000, 30_000], True), (["", 30_000, 30_000], True),
    ([10_000, 10_000.5], True), (["", "", 50_000], False)])
def test_micros_follow_the_exact_median(spark, tmp_path, costs, divided):
    body = "".join(f"{i},1,2024-01-01,{c},1,SEARCH,A\n" for i, c in enumerate(costs))
    write(tmp_path, "google.csv", GOOGLE + body)
    got = sum(r[5] for r in rows(P.load_platform(spark, str(tmp_path), "google")))
    total = sum(float(c or 0) for c in costs)
    assert got == pytest.approx(total / 1e6 if divided else total, abs=1e-6)


def test_bad_amounts_become_zero(spark, tmp_path):
    cells = ["1.0d", "NaN", "abc", " 7 ", "+2.5e1", ".5", "5."]
    write(tmp_path, "bing.csv", BING + "".join(f"{i},1,2024-01-01,{c},1,3,S,A\n" for i, c in enumerate(cells)))
    got = sorted(r[4] for r in rows(P.load_platform(spark, str(tmp_path), "bing")))
    assert got == [0.0, 0.0, 0.0, 0.5, 5.0, 7.0, 25.0]


def test_malformed_date_fails_or_becomes_null(spark, tmp_path):
    write(tmp_path, "bing.csv", BING + "0,1,2024-13-45,1,1,3,S,A\n1,1,,2,1,3,S,A\n2,1,1/31/2024,3,1,3,S,A\n")
    with pytest.raises(Exception, match="unreadable date"):
        P.load_platform(spark, str(tmp_path), "bing").collect()
    kept = P.load_platform(spark, str(tmp_path), "bing", bad_dates="null")
    assert sorted((str(r["ds"]), float(r["revenue"])) for r in kept.collect()) == [
        ("2024-01-31", 3.0), ("None", 1.0), ("None", 2.0)]


def test_missing_channels(spark, tmp_path):
    write(tmp_path, "meta_ads_campaign_stats.csv", META + "0,7,2024-01-01,1,2,A_B\n")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert len(rows(P.load_all(spark, str(tmp_path)))) == 1
    assert sum("skipped" in str(w.message) for w in seen) == 2
    empty = tmp_path / "empty"
    empty.mkdir()
    write(empty, "readme.txt", "x")
    with pytest.warns(UserWarning), pytest.raises(RuntimeError, match="no usable data files"):
        P.load_all(spark, str(empty))


def test_validation_report(spark, tmp_path):
    write(tmp_path, "bing_ads.csv", BING + "0,1,the 3rd,1,,3,S,A\n1,1,2024-01-01,many,2,3,S,A\n")
    write(tmp_path, "google_ads_campaign_stats.csv", "a,b,c\n1,2,3\n")
    report = {r["channel"]: r for r in P.validate(spark, str(tmp_path)).collect()}
    codes = {c: [(f.code, f.subject, f["count"]) for f in r.findings] for c, r in report.items()}
    assert report["bing"]["found"] and report["bing"]["date_col"] == "TimePeriod" and report["bing"]["n_rows"] == 2
    assert codes["bing"] == [("other_name", "bing_ads.csv", None), ("bad_cells", "date", 1), ("bad_cells", "revenue", 1),
                             ("blank_cells", "spend", 1)]
    assert not report["meta"]["found"] and codes["meta"] == [("absent", None, None)]
    assert report["google"]["columns"] == ["a", "b", "c"] and report["google"]["date_col"] is None
    assert codes["google"] == [("no_column", c, 1) for c in ("date", "revenue", "spend")] + [("empty", None, None)]
    assert all(f.text for r in report.values() for f in r.findings)


def test_part_files_of_several_layouts(spark, tmp_path):
    folder = tmp_path / "bing ads [1].csv"
    folder.mkdir()
    write(folder, "a 1.csv", "Date,Revenue,Spend,Campaign\n2024-01-01,1,2,A\n")
    write(folder, "b{2}.csv", "Spend,Date,Campaign,Revenue\n3,2024-01-02,\"two\nlines, \"\"x\"\"\",4\n")
    write(folder, "c.csv", "\ufeffDate,revenue,Cost\n2024-01-03,5,6\n2024-01-04,7,8\n")
    write(folder, "d.csv", "Day,Clicks\n2024-01-05,9\n")
    write(folder, "e.csv", "")
    with pytest.warns(UserWarning, match="revenue, spend"):
        got = rows(P.load_platform(spark, str(tmp_path), "bing"))
    assert got == sorted([
        ("bing", "unknown", "A", date(2024, 1, 1), 1.0, 2.0), ("bing", "unknown", 'two\nlines, "x"', date(2024, 1, 2), 4.0, 3.0),
        ("bing", "unknown", "unknown", date(2024, 1, 3), 5.0, 6.0), ("bing", "unknown", "unknown", date(2024, 1, 4), 7.0, 8.0)])
    data, header = P.read_ads_csv(spark, str(folder))
    assert set(header.names) == {"Date", "Revenue", "Spend", "Campaign", "revenue", "Cost", "Day", "Clicks"} and data.count() == 5
    report = {r["channel"]: [f.code for f in r.findings] for r in P.validate(spark, str(tmp_path)).collect()}
    assert report["bing"] == ["other_name", "no_column", "no_column", "mixed", "line_breaks"]


def test_loader_options_reach_every_platform(spark, canonical):
    write(canonical, "bing_campaign_stats.csv", BING + "0,1,03/01/2024,1,1,3,S,A\n")
    days = {r.channel: r.ds for r in P.load_all(spark, str(canonical), date_formats=("d/M/yyyy",)).where("channel = 'bing'").collect()}
    assert days == {"bing": date(2024, 1, 3)}
    assert P.load_all(spark, str(canonical), multi_line=True).count() == 5


def test_amounts_beyond_all_money(spark, tmp_path):
    write(tmp_path, "bing.csv", BING + "0,1,2024-01-01,1e13,2,3,S,A\n1,1,2024-01-02,1e40,1e300,3,S,A\n")
    assert [r[4:] for r in rows(P.load_platform(spark, str(tmp_path), "bing"))] == [(1e13, 2.0), (0.0, 0.0)]


def test_only_the_top_level_is_searched(spark, tmp_path):
    deep = tmp_path / "x" / "x"
    deep.mkdir(parents=True)
    write(deep, "bing.csv", BING)
    write(tmp_path / "x", "meta.csv", META)
    found = {r["channel"]: r["source_name"] for r in P.discover_sources(spark, str(tmp_path / "x")).collect()}
    assert found == {"bing": None, "meta": "meta.csv", "google": None}
