"""Sources, sinks, ingestion and streams on small files."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from terrane.operators import ingestion
from terrane.operators import phrases
from terrane.products.places import lexicon
from terrane.products.queries import parsed
from terrane.sources import readers, sinks
from terrane.streaming import limiter, windows

DEFAULTS = {
    "transaction_id": "t0", "trans_group_en": "Sales", "procedure_name_en": "Sell", "instance_date": "05-03-2021", "property_type_en": "Unit", "property_sub_type_en": "Flat",
    "property_usage_en": "Residential", "reg_type_en": "Existing Properties", "area_id": "7", "area_name_en": "AL BARSHA SOUTH", "area_name_ar": "x", "building_name_en": "null",
    "project_number": "12", "project_name_en": "null", "master_project_en": "null", "nearest_landmark_en": "null", "nearest_metro_en": "null", "nearest_mall_en": "null",
    "rooms_en": "2 B/R", "has_parking": "1", "procedure_area": "100", "actual_worth": "1000000", "no_of_parties_role_1": "1", "no_of_parties_role_2": "2", "no_of_parties_role_3": "null",
}
COLUMNS = list(DEFAULTS)


def line(i, **changes):
    return DEFAULTS | {"transaction_id": f"t{i}", "actual_worth": str(1_000_000 + i * 1000)} | changes


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    rows = [line(i) for i in range(40)] + [line(3), line(50, trans_group_en="Gifts"), line(51, procedure_name_en="null"), line(52, instance_date="31-02-2021"), line(53, actual_worth="null"), line(54, procedure_area="0"), line(55, actual_worth="9999"), line(58, has_parking="2", property_sub_type_en="null"), line(56, actual_worth="90000000"), line(57, actual_worth="92903")]
    path = tmp_path_factory.mktemp("csv") / "in.csv"
    path.write_text("\n".join([",".join(COLUMNS), *[",".join(r[c] for c in COLUMNS) for r in rows]]))
    return readers.read_strict_csv(spark, str(path), COLUMNS).withColumn("source_row", F.monotonically_increasing_id()), str(path)


def test_strict_columns_and_domains(spark, raw):
    with pytest.raises(readers.SchemaDriftError):
        readers.read_strict_csv(spark, raw[1], COLUMNS[1:])
    with pytest.raises(readers.SchemaDriftError, match="Gifts"):
        readers.validate_domains(raw[0], {"trans_group_en": ("Sales", "Mortgages")})
    readers.validate_domains(raw[0], {"trans_group_en": tuple(ingestion.GROUPS), "property_type_en": ingestion.TYPES})


def test_ingestion_gives_one_reason_per_row(raw):
    out = ingestion.classify(ingestion.to_typed(raw[0])).collect()
    reasons = {}
    for r in out:
        reasons.setdefault(r.exclusion_reason, []).append(r.transaction_id)
    assert sorted(reasons.pop(None)) == sorted([*(f"t{i}" for i in range(40)), "t58"])
    assert reasons == {"duplicate_transaction_id": ["t3"], "gift": ["t50"], "non_market_procedure": ["t51"], "missing_date": ["t52"], "missing_price": ["t53"], "invalid_area": ["t54"], "price_below_floor": ["t55"], "price_outlier_high": ["t56"], "suspected_sqft_entry": ["t57"]}


def test_typed_table_has_29_columns(raw):
    out = ingestion.to_typed(raw[0])
    assert len(out.columns) == 29
    rows = {r.transaction_id: r for r in out.collect()}
    a, b = rows["t1"], rows["t58"]
    assert (a.property_type, a.reg_type, a.year, a.bedrooms, a.has_parking, a.project_number, a.parties_role_2, a.parties_role_3) == ("unit", "ready", 2021, 2, True, 12, 2, None)
    assert a.price_per_sqm_aed == 10_010.0 and b.has_parking is None and b.property_sub_type is None


def test_classify_fails_without_a_peer_group(raw):
    few = ingestion.to_typed(raw[0].where("transaction_id in ('t1', 't2')"))
    with pytest.raises(Exception, match="no peer group"):
        ingestion.classify(few).collect()


def test_price_floor_keeps_ten_thousand(raw):
    price = F.when(F.col("transaction_id") == "t1", "10000").when(F.col("transaction_id") == "t2", "49999").otherwise(F.col("actual_worth"))
    out = {r.transaction_id: r.exclusion_reason for r in ingestion.classify(ingestion.to_typed(raw[0].withColumn("actual_worth", price))).collect()}
    assert out["t1"] != "price_below_floor" != out["t2"]


def test_areas_that_share_a_key_all_stay(spark):
    areas = spark.createDataFrame([(1, "Al Barsha", "barsha"), (2, "Barsha", "barsha")], "area_id long, name_en string, match_key string")
    none = spark.createDataFrame([], "master_project string, area_id long")
    kept, _ = ingestion.aliases(areas, none, spark.createDataFrame([("BB", "Barsha"), ("Al-Barsha", "barsha")], "alias string, area_name_en string"))
    assert sorted((r.alias_key, r.area_id, r.source) for r in kept.collect()) == [("barsha", 1, "official"), ("barsha", 2, "official"), ("bb", 1, "curated"), ("bb", 2, "curated")]


def test_areas_and_aliases(spark, raw):
    classified = ingestion.classify(ingestion.to_typed(raw[0]))
    areas = ingestion.areas(classified)
    row = areas.first()
    assert (row.area_id, row.name_en, row.match_key, row.market_sales) == (7, "Al Barsha South", "barsha south", 41)
    curated = spark.createDataFrame([("ABS", "al barsha south"), ("nowhere", "Nowhere")], "alias string, area_name_en string")
    kept, lost = ingestion.aliases(areas, classified, curated)
    assert {(r.alias_key, r.source) for r in kept.collect()} == {("barsha south", "official"), ("abs", "curated")}
    assert [r.alias for r in lost.collect()] == ["nowhere"]


def test_json_lines_skip_what_is_no_object(spark, tmp_path):
    (tmp_path / "log").write_text('{"path": "/a", "status": 200}\nnot json\n[1]\n{"path": "/b", "status": 500}\n')
    assert readers.read_json_lines(spark, str(tmp_path / "log"), "path string, status int").count() == 2


def test_sinks(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(5)
    assert sinks.replace_table(df, path, 5) == 5
    with pytest.raises(sinks.RowCountError):
        sinks.replace_table(spark.range(3), path, 4)
    assert spark.read.parquet(path).count() == 5
    assert sinks.replace_table(spark.range(9), path) == 9 and spark.read.parquet(path).count() == 9
    assert not list(tmp_path.glob("*__old-*"))
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, sinks.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sinks.content_digest(old) == sinks.content_digest(old.orderBy(F.desc("k"))) != sinks.content_digest(new)
    ledger = str(tmp_path / "runs")
    sinks.log_run(spark, ledger, "r1", "build", "succeeded", 5)
    sinks.log_run(spark, ledger, "r2", "build", "failed")
    assert sinks.latest_run(spark.read.parquet(ledger), "build").first().run_id == "r1"


def test_phrases_equal_trying_each_place():
    rng = random.Random(3)
    for _ in range(200):
        known = {tuple(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 8))}
        words = rng.choices("abcd", k=30)
        automaton = phrases.Automaton([list(k) for k in sorted(known)])
        every = sorted((i, i + len(k)) for k in known for i in range(len(words)) if tuple(words[i : i + len(k)]) == k)
        assert sorted((a, b) for a, b, _ in automaton.every(words)) == every
        expected, i = [], 0
        while i < len(words):
            size = max((b - a for a, b in every if a == i), default=0)
            expected += [(i, i + size)] if size else []
            i += max(size, 1)
        found = automaton.longest(words)
        assert [(a, b) for a, b, _ in found] == expected and all(tuple(words[a:b]) == sorted(known)[p] for a, b, p in found)


def test_phrases_of_odd_rows(spark):
    dictionary = spark.createDataFrame([("a b", 1), ("a b", 0), (None, 2), ("", 3), ("c", 4)], "phrase string, place int")
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, None), (3, []), (4, [None, "c"])], "n int, words array<string>")
    found, numbered = phrases.with_phrases(rows, "words", dictionary, "phrase")
    known = {r.number: r.place for r in numbered.collect()}
    assert {r.n: [(m.start, m.end, known[m.phrase]) for m in r.found] for r in found.collect()} == {1: [(0, 2, 0), (2, 3, 4)], 2: [], 3: [], 4: [(1, 2, 4)]}


def place_lexicon(spark):
    make = lambda rows: spark.createDataFrame(rows, "name string, area_id long")
    areas = make([("Dubai Marina", 1), ("Business Bay", 3), ("Al Barsha", 4), ("Barsha", 6)])
    buildings = make([("Marina Gate", 1), ("Lakeside", 9), ("Luma21", 9), ("The Villa", 9), ("Business Bay", 9), ("Tiny", 9), ("Dubai Studio City", 8), (None, 1), ("--", 1)])
    return lexicon(areas, make([("Marina", 1), ("Marina", 2)]), buildings, make([("Marina Gate", 5), ("Project 5", 5)]), make([("The Springs 3 - East", 500)]))


PLACES = [
    ("flat at Marina Gate", {"building": "Marina Gate", "building_area_ids": [1], "area_ids": [], "unknown_places": []}),
    ("marina, business bay", {"area_name": "Marina", "area_ids": [1, 2], "building": None}),
    ("villa in al barsha", {"area_ids": [4, 6], "area_name": "Al Barsha"}),
    ("villa with lakeside view", {"building": None, "words": ["lakeside", "view"]}),
    ("flat near the Lakeside", {"building": "Lakeside", "unknown_places": []}),
    ("show me the villa with pool", {"building": None, "kind": "villa", "amenities": ["shared pool"]}),
    ("flat at The Villa", {"building": "The Villa", "kind": "flat"}),
    ("luma21 studio tiny", {"building": "Luma21", "bedrooms": 0, "words": ["tiny"]}),
    ("2 bed in Dubai Studio City 1.2m", {"building": "Dubai Studio City", "bedrooms": 2, "max_price": 1.2e6}),
    ("villa in the Springs", {"area_ids": [500], "unknown_places": []}),
    ("villa in project 5 up to 900k", {"building": "Project 5", "max_price": 9e5}),
    ("no more than 2m, 24/7 security and maid's room", {"max_price": 2e6, "amenities": ["24/7 security", "maid's room"]}),
]


def test_queries_name_places(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PLACES)], "n int, text string")
    got = {r.n: r.slots for r in parsed(rows, lexicon=place_lexicon(spark)).collect()}
    for i, (text, wanted) in enumerate(PLACES):
        assert {k: got[i][k] for k in wanted} == wanted, text


QUERIES = [
    ("2 bed flat under 1.5m near park 90 sqm", {"bedrooms": 2, "kind": "flat", "max_price": 1.5e6, "min_price": None, "min_size": 90.0, "unknown_places": []}),
    ("villa between 900k and 1.2m with pool and gym", {"kind": "villa", "min_price": 9e5, "max_price": 1.2e6, "amenities": ["shared pool", "gym access"]}),
    ("1-1.5M townhouse in the Springs", {"min_price": 1e6, "max_price": 1.5e6, "kind": "townhouse", "unknown_places": ["springs"]}),
    ("900-1.2m flat", {"min_price": 9e5, "max_price": 1.2e6}),
    ("serviced apartment 850,000 two bedrooms", {"kind": "hotel_apartment", "max_price": 850_000.0, "bedrooms": 2}),
    ("studio over 1,000 sqft from aed 500", {"bedrooms": 0, "min_size": 92.9, "min_price": 500.0, "max_price": None}),
    ("plot in dubai hills estate min 2 million", {"unlisted": ["plot"], "min_price": 2e6, "unknown_places": ["dubai hills estate"]}),
    ("from 3m to 2m", {"min_price": None, "max_price": None, "errors": ["budget_min_exceeds_max"]}),
    ("quiet home for 4", {"bedrooms": None, "max_price": None, "words": ["quiet"]}),
    ("", {"bedrooms": None, "words": [], "amenities": []}),
    (None, {"kind": None, "words": []}),
]


def test_query_parser(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(QUERIES)], "n int, text string")
    got = {r.n: r.slots for r in parsed(rows).collect()}
    for i, (text, wanted) in enumerate(QUERIES):
        assert {k: got[i][k] for k in wanted} == wanted, text


def test_token_bucket_in_batch_and_stream(spark, tmp_path):
    rows = [("a", 1, 0.0), ("a", 2, 0.1), ("a", 3, 0.2), ("a", 4, 10.0), ("b", 5, 0.0)]
    batch = spark.createDataFrame(rows, "who string, n int, at double")
    got = {r.n: r.admitted for r in limiter.admitted(batch, "who", "at", "n", 2.0, 0.2).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limiter.admitted_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "who", "at", 2.0, 0.2)
    windows.write_available(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("admitted").count() == 4


def test_stream_windows_drop_late_rows(spark, tmp_path):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    make = lambda rows: spark.createDataFrame(rows, "ts timestamp, k string, v double").coalesce(1)
    make([(at(0, 5), "a", 1.0), (at(0, 50), "a", 2.0), (at(9), "a", 4.0)]).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
    run = lambda: windows.write_available(windows.windowed_counts(source(), "ts", ["k"], "v", "1 hour"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    make([(at(0, 10), "a", 100.0), (at(20), "a", 8.0)]).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {r.start.hour: (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0] == (2, 3.0) and got[9] == (1, 4.0)
    assert json.dumps(sorted(got)) in ("[0, 9]", "[0, 9, 20]")
