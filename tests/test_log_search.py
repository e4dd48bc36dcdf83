"""Pages, lookups and substring search over a log written by day, against plain ways over the whole of it."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from weirgate.operators import log_analytics as A
from weirgate.operators import log_search as S
from weirgate.plans import queries as plans
from weirgate.sources.exports import write_logs

SF = "/root/testdata/sf0.001"
COLUMNS = "created_at timestamp_ntz, request_id string, client_ip string, application_id string, action_taken string, triggered_layer string, is_blocked boolean, risk_score double, execution_time_ms double, raw_prompt string"


def log_of(spark, keys, prompts=None):
    rows = [(at, rid, "c", "a", "PASSED", "NONE", False, 0.5, 1.0, (prompts or {}).get(rid, "p")) for at, rid in keys]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "log")
    write_logs(plans.logs(spark, SF).drop("kind").repartition(3), path)
    return path


def scanned(df):
    """Rows that the scans of a collected frame gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan()
    todo, total = [plan], 0
    while todo:
        p = todo.pop()
        if "QueryStage" in p.nodeName():
            todo.append(p.plan())
            continue
        if p.nodeName().startswith("Scan parquet"):
            total += p.metrics().apply("numOutputRows").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return total


def test_pages_equal_the_whole_order(spark, written):
    log = spark.read.parquet(written)
    for filters in (A.LogFilters(), A.LogFilters(is_blocked=True), A.LogFilters(client_ip="nobody")):
        want = [r.request_id for r in log.where(filters.predicate()).orderBy(A.F.desc("created_at"), A.F.desc("request_id")).collect()]
        days = S.day_counts(log, filters)
        assert sum(n for _, n in days) == len(want)
        size, rows, at = 37, [], None
        for page in (1, 2, 3, 10**6):
            got, number, pages = S.page_at(log, filters, page, size, days)
            assert pages == max(1, -(-len(want) // size)) and number == min(page, pages)
            rows = got.collect()
            assert [r.request_id for r in rows] == want[(number - 1) * size : number * size]
            assert [r.request_id for r in S.page_at(log, filters, page, size, days, stretch=5)[0].collect()] == [r.request_id for r in rows]
            if rows and number < pages:
                at = S.cursor_of(rows[-1])
                for directory in (None, days):
                    assert [r.request_id for r in S.page_after(log, filters, at, size, directory).collect()] == want[number * size : (number + 1) * size]


def test_a_late_page_reads_its_days_only(spark, written):
    log = spark.read.parquet(written)
    days = S.day_counts(log, A.LogFilters())
    page, number, pages = S.page_at(log, A.LogFilters(), 10, 50, days)
    assert (number, pages) == (10, 20) and scanned(page) <= 3 * max(n for _, n in days) < log.count() / 2
    after = S.page_after(log, A.LogFilters(), S.cursor_of(page.collect()[-1]), 50, days)
    assert scanned(after) <= 4 * max(n for _, n in days)


def test_a_full_moment_ties_and_missing_keys(spark):
    rng, moment = random.Random(3), datetime(2024, 1, 5, 10, 0, 0)
    keys = [(moment, f"r{i:03d}") for i in range(300)] + [(moment, "é"), (moment, ""), (moment - timedelta(microseconds=1), None), (moment + timedelta(hours=9), "z")] + [(None, "n1"), (None, None), (None, "n2")]
    rng.shuffle(keys)
    log = log_of(spark, keys)
    order = sorted(keys, key=lambda k: (k[0] is not None, k[0] or moment, (k[1] or "").encode()), reverse=True)
    for stretch in (3, 10, 100_000):
        got = [(r.created_at, r.request_id) for page in (1, 2, 16, 30, 31) for r in S.page_at(log, A.LogFilters(), page, 10, stretch=stretch)[0].collect()]
        assert got == [k for page in (1, 2, 16, 30, 31) for k in order[(page - 1) * 10 : page * 10]]
    seen, days = S.page_at(log, A.LogFilters(), 1, 100)[0].collect(), S.day_counts(log, A.LogFilters())
    while more := S.page_after(log, A.LogFilters(), S.cursor_of(seen[-1]), 100, days).collect():
        seen += more
    assert [(r.created_at, r.request_id) for r in seen] == order
    assert S.page_at(log.limit(0), A.LogFilters())[0].collect() == []


def test_lookups_pass_over_row_groups(spark, written, tmp_path):
    log = spark.read.parquet(written)
    ids = {r.request_id for r in log.select("request_id").collect()}
    absent = next(f"req-{i}" for i in range(1000, 10**6) if f"req-{i}" not in ids)
    assert scanned(A.detail(log, "req-77")) < log.count() / 5 and A.detail(log, "req-77").count() == ("req-77" in ids)
    assert scanned(log.where(A.F.col("request_id") == absent)) == 0
    plan = str(tmp_path / "plain")
    plans.logs(spark, SF).drop("kind").repartition(3).write.parquet(plan)
    assert scanned(spark.read.parquet(plan).where(A.F.col("request_id") == absent)) > 0


def test_index_of_substrings(spark, tmp_path):
    rng = random.Random(5)
    words = ["alpha", "Überfall", "naïve", "100%_sure", "back\\slash", "日本語のテスト", "zeta", "ab", ""]
    days = [datetime(2024, 1, d) for d in range(1, 9)]
    keys = [(at, f"r{i}-{at.day}") for at in days for i in range(20)]
    prompts = {rid: " ".join(rng.choices(words[:4] if at.day < 5 else words[4:], k=4)) + f" only{at.day}" for at, rid in keys}
    prompts["r3-2"] = None
    path = str(tmp_path / "log")
    write_logs(log_of(spark, keys, prompts), path)
    log = spark.read.parquet(path)
    S.file_signatures(log, "raw_prompt").write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    files = len(log.inputFiles())
    for text in ("ALPHA", "über", "%_S", "k\\s", "本語の", "only7", "nowhere at all", "ab", "", "eta ZETA"):
        want = sorted(r.request_id for r in log.where(A.LogFilters(text=text).predicate()).collect())
        assert sorted(r.request_id for r in S.indexed_search(spark, path, index, A.LogFilters(text=text)).collect()) == want, text
    assert S.files_that_may_hold(index, "only7").count() < files / 4 and S.files_that_may_hold(index, "nowhere at all").count() == 0
    write_logs(log_of(spark, [(datetime(2024, 2, 1), "late")], {"late": "nowhere at all"}), path)  # newer than the index
    assert [r.request_id for r in S.indexed_search(spark, path, index, A.LogFilters(text="nowhere at all")).collect()] == ["late"]


def test_signatures_of_long_texts_equal_brute_force(spark, tmp_path, monkeypatch):
    """Texts over the borders of steps and rows: a file has the trigrams of its texts, none across two of them, and no others."""
    monkeypatch.setattr(S, "STEP", 64)
    rng = random.Random(6)
    texts = ["".join(rng.choices("abCDÜ日 ", k=rng.choice([0, 1, 2, 3, 40, 300]))) for _ in range(60)] + [None]
    path = str(tmp_path / "texts")
    spark.createDataFrame([(t,) for t in texts], "t string").repartition(3).write.parquet(path)
    found = {}
    for r in S.file_signatures(spark.read.parquet(path), "t").collect():
        found.setdefault(r.file, set()).update((r.bucket - 1) * S.BITMAP + 8 * i + b for i, byte in enumerate(r.bits) for b in range(8) if byte >> b & 1)
    want = {}
    for r in spark.read.parquet(path).selectExpr("_metadata.file_path as file", "t").collect():
        data = (r.t or "").lower().encode()
        want.setdefault(r.file, set()).update((int.from_bytes(data[i : i + 3], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 12 for i in range(len(data) - 2))
    assert found == {f: bits for f, bits in want.items() if bits}


def test_either_of_two_phrases_in_one_pass(spark, tmp_path):
    """Rows that share an id count each, as in the SQL; the table is read once for the signatures and once for the rows."""
    rows = [(1, "a Password"), (1, "THE COUNCIL and the password"), (None, "the council"), (None, "my password"), (2, "council"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES["indexed_substrings"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(str(r[0]) for r in con.execute(plans.ORACLES["indexed_substrings"]).fetchall()) == ["1", "1", "None", "None"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


def test_newest_samples_are_cut_before_they_are_shuffled(spark):
    rows = plans.logs(spark, SF)
    plan = A.latency_stats(rows, 5)._jdf.queryExecution().executedPlan().toString()
    first = plan.rindex("Exchange")
    assert "WindowGroupLimit" in plan[first:] and "Partial" in plan[first:]
    got = {r.application_id: tuple(r)[1:] for r in A.latency_stats(rows.repartition(7), 5).collect()}
    frame = rows.toPandas().sort_values(["created_at", "request_id"], ascending=False)
    for app, x in frame.groupby("application_id"):
        s = sorted(x.execution_time_ms.head(5))
        assert got[app] == (5, round(s[2], 3), round(s[4], 3), round(s[-1], 3))
