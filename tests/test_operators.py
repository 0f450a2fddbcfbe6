import datetime as dt
import os
import random
import re
import tracemalloc
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contentmill.functions import text
from contentmill.operators import anchors, catalog, draws, generation, matching, store
from contentmill.sources import files

T = dt.datetime


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


@pytest.fixture
def stock(spark):
    data = [(1, "A", [T(2024, 1, 1), T(2024, 2, 1)]), (2, "A", []), (3, "A", None), (4, "A", [T(2023, 1, 1)]), (5, "A", [T(2024, 5, 1)]), (6, "B", [])]
    return spark.createDataFrame(data, "id long, s string, used array<timestamp>")


def test_reuse_order(stock):
    assert [r[0] for r in rows(draws.candidates(stock.where("s = 'A'"), "used", "id"), "id")] == [2, 3, 4, 5, 1]
    assert [r[0] for r in rows(draws.draw(stock, 2, "used", "id"), "id")] == [2, 3]
    with pytest.raises(draws.ShortStock):
        draws.draw(stock, 7, "used", "id")


def test_stratified_is_all_or_nothing(spark, stock):
    quotas = lambda a, b: spark.createDataFrame([("B", b, 0), ("A", a, 1)], "s string, quantity int, position int")
    assert rows(draws.draw_stratified(stock, quotas(2, 1), "s", "used", "id", largest=2), "id", "rank") == [(6, 1), (2, 1), (3, 2)]
    assert rows(draws.draw_stratified(stock, quotas(2, 5), "s", "used", "id")) == []
    assert rows(draws.shortages(stock, quotas(2, 5), "s")) == [("B", 5, 1)]


def test_draw_plan_keeps_the_group_limit(stock):
    plan = draws.candidates(stock, "used", "id").limit(3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_round_robin(spark):
    topics = spark.createDataFrame([(0, "t0"), (1, "t1"), (2, "t2")], "o int, t string")
    assert [r.t for r in draws.round_robin(topics, "o", 5).orderBy("i").collect()] == ["t0", "t1", "t2", "t0", "t1"]
    assert [r.t for r in draws.round_robin(topics, "o", 2).orderBy("i").collect()] == ["t0", "t1"]


def test_first_seen(spark):
    book = spark.createDataFrame([("M1", "T1", 0), ("M1", "T2", 1), ("M1", "T1", 2)], "m string, t string, o long")
    bank = spark.createDataFrame([("M2", "T5", 1), ("M1", "T1", 2)], "m string, t string, o long")
    assert rows(catalog.first_seen([(book, ["o"]), (bank, ["o"])], ["m", "t"]), "m", "t") == [("M1", "T1"), ("M1", "T2"), ("M2", "T5")]


def test_upsert(spark):
    new = spark.createDataFrame([(0, "h1"), (1, "h1"), (2, "h2")], "p int, h string")
    stored = spark.createDataFrame([("h2",)], "h string")
    fresh = store.new_rows(new, stored, ["h"], "p")
    assert rows(fresh, "p") == [(0,)]
    assert rows(store.upsert_counts(new, fresh)) == [(1, 2)]
    assert store.new_rows(new, stored.union(fresh.select("h")), ["h"], "p").isEmpty()
    with pytest.raises(store.Conflict):
        store.insert_strict(new, stored, ["h"])
    assert store.insert_strict(new.where("p = 0"), stored, ["h"]).count() == 1


def test_review(spark):
    schema = "id long, status string, revisado_por string, revisado_em timestamp, motivo_rejeicao string"
    stored = spark.createDataFrame([(1, "pendente_revisao", None, None, None), (2, "pendente_revisao", None, None, None)], schema)
    told = lambda d: spark.createDataFrame([(1, d, "r", "why")], "id long, decision string, reviewer string, reason string")
    at = F.lit("2025-01-01 00:00:00").cast("timestamp")
    no = store.review(stored, told("rejeitada"), at=at)
    assert rows(no.orderBy("id"), "status", "motivo_rejeicao") == [("rejeitada", "why"), ("pendente_revisao", None)]
    assert rows(store.review(no, told("aprovada"), at=at).orderBy("id"), "status", "motivo_rejeicao")[0] == ("aprovada", None)
    with pytest.raises(store.BadDecision):
        store.review(stored, told("publicada"))
    with pytest.raises(store.Missing):
        store.review(stored.where("id = 2"), told("aprovada"))


def test_changes(spark):
    stored = spark.createDataFrame([(1, "banco_real"), (2, "mestre_questoes"), (3, "simulado_migrado")], "id long, origem string")
    kept, gone = store.delete_curated(stored, spark.createDataFrame([(1,), (2,)], "id long"))
    assert sorted(rows(kept, "id")) == [(2,), (3,)] and rows(gone, "id") == [(1,)]
    changed = store.update_by_key(stored, spark.createDataFrame([(1, "x")], "id long, origem string"), ["id"], ["origem"])
    assert sorted(rows(changed, "id", "origem", "matched"))[0] == (1, "x", True)
    bad = store.invalid_rows(stored, ["id"], {"origem": ["banco_real"]})
    assert sorted(rows(bad, "id", "broken")) == [(2, ["origem"]), (3, ["origem"])]
    fresh = store.next_ids(stored, spark.createDataFrame([("b",), ("a",)], "t string"), "t")
    assert sorted(rows(fresh, "t", "id")) == [("a", 4), ("b", 5)]
    ready = store.prepare_curated(spark.createDataFrame([("RLM", "Observe a figura"), ("x", "y")], "materia string, enunciado string"))
    assert sorted(rows(ready, "materia", "status")) == [("Raciocínio Lógico Matemático", "pendente_revisao"), ("x", "aprovada")]


def test_asof_and_intervals(spark):
    anchors = spark.createDataFrame([(1, 5, "a"), (1, 9, "b")], "d int, p int, l string")
    probes = spark.createDataFrame([(1, 4), (1, 5), (1, 8), (1, 20), (2, 7)], "d int, p int")
    assert sorted(rows(matching.asof_backward(probes, anchors, ["d"], "p", "l"))) == [(1, 4, None), (1, 5, "a"), (1, 8, "a"), (1, 20, "b"), (2, 7, None)]
    inside = matching.inside_item(probes, anchors.select("d", "p").where("p = 5"), anchors.select("d", "p").where("p = 9"), ["d"], "p")
    assert sorted(rows(inside)) == [(1, 4, False), (1, 5, True), (1, 8, True), (1, 20, False), (2, 7, False)]
    spans = spark.createDataFrame([(1, 1, 5, 0, ""), (1, 1, 8, 1, "x")], "d int, lo int, hi int, o int, v string")
    found = matching.first_interval(probes, spans, ["d"], "p", start="lo", end="hi", order="o", value="v")
    assert sorted(rows(found, "d", "p", "v"), key=str) == sorted([(1, 4, None), (1, 5, None), (1, 8, "x"), (1, 20, None), (2, 7, None)], key=str)


def test_alignment(spark):
    assert matching.common_subsequence([1, 2, 3, 1, 2, 3], [1, 3, 1, 2, 3]) == [(0, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    rng = random.Random(3)

    def longest(a, b):
        best = 0
        for mask in range(1 << len(a)):
            s = [x for i, x in enumerate(a) if mask >> i & 1]
            it = iter(b)
            best = max(best, len(s)) if all(x in it for x in s) else best
        return best

    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(8))] for _ in range(2))
        pairs = matching.common_subsequence(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(set(pairs))
    left = spark.createDataFrame([("x", 0, 1), ("x", 1, 2), ("y", 0, 9)], "d string, o int, n int")
    right = spark.createDataFrame([("x", 0, 2)], "d string, o int, n int")
    assert set(rows(matching.lcs_align(left, right, "d", "o", "n"))) == {("x", 0, None), ("x", 1, 0), ("y", 0, None)}


def test_fuzzy_joins_make_no_cross_product(spark):
    bank = spark.createDataFrame([("Dir Penal",), ("Xadrez",), (None,)], "m string")
    books = spark.createDataFrame([("Direito Penal",), ("op bloco iii",)], "b string")
    assert rows(matching.fuzzy_semi(bank, "m", books, "b")) == [("Dir Penal",)]
    anti = matching.fuzzy_anti(bank, "m", books, "b")
    assert set(rows(anti)) == {(None,), ("Xadrez",)}
    plan = anti._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Cartesian" not in plan


def test_points_and_spans_meet_by_bins(spark):
    """One key with many spans and points: only hits meet, at any length of span, below zero too."""
    rng = random.Random(13)
    spans = [(1, lo, lo + rng.choice((-1, 0, 1, 2, 7, 40, 1000)), i, f"v{i % 7}" if i % 5 else "") for i in range(1500) for lo in (rng.randrange(-50_000, 50_000),)]
    points = [(rng.choice((1, 1, 1, None, 2)), rng.choice((None, *(rng.randrange(-50_000, 50_000) for _ in range(30))))) for _ in range(1500)]
    p, s = spark.createDataFrame(points, "d int, at long"), spark.createDataFrame(spans, "d int, lo long, hi long, o int, v string")
    hits = sum(d == 1 and x is not None and lo <= x <= hi for d, x in points for _, lo, hi, _, _ in spans)
    met = matching._span_candidates(p, s, ["d"], "at", "lo", "hi", {"o": "_o"})
    assert met.where("_o is not null").count() == hits > 1000
    first = lambda d, x: next((v or None for _, lo, hi, _, v in spans if d == 1 and x is not None and lo <= x <= hi), None)
    found = matching.first_interval(p, s, ["d"], "at", start="lo", end="hi", order="o", value="v")
    assert sorted(map(repr, rows(found, "d", "at", "v"))) == sorted(repr((d, x, first(d, x))) for d, x in points)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join LeftOuter, ((((" in plan.replace("\n", "") or "_number" in plan
    halves = matching.first_interval(p.select("d", (F.col("at") + F.lit(0.5)).alias("at")), s, ["d"], "at", start="lo", end="hi", order="o", value="v")
    half = lambda d, x: next((v or None for _, lo, hi, _, v in spans if d == 1 and x is not None and lo <= x + 0.5 <= hi), None)
    assert sorted(map(repr, rows(halves, "d", "v"))) == sorted(repr((d, half(d, x))) for d, x in points)


def test_long_sequences_align_in_little_memory():
    rng = random.Random(12)
    a = [rng.randrange(2000) for _ in range(8000)]
    b = [x for x in a if rng.random() < 0.9]
    tracemalloc.start()
    pairs = matching.common_subsequence(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == len(b) and all(a[i] == b[j] for i, j in pairs) and most < 8 << 20


def test_a_hot_key_is_cut_into_stretches(spark, monkeypatch):
    """Half of the rows under one key: the same rows as without cuts, over many groups of the window."""
    rng = random.Random(9)
    rows_of = lambda n, of: [(rng.choice((None, 1, 1, 1, 2, 3)), rng.choice((None, *range(300))), of(i)) for i in range(n)]
    probes = spark.createDataFrame(rows_of(800, lambda i: i), "d int, p int, x int")
    anchors_ = spark.createDataFrame(rows_of(60, lambda i: rng.choice((None, "a", "b", "c"))), "d int, p int, l string")
    ends = anchors_.select("d", (F.col("p") + 3).alias("p"))

    def both():
        return sorted(map(repr, rows(matching.asof_backward(probes, anchors_, ["d"], "p", "l")))), sorted(map(repr, rows(matching.inside_item(probes, anchors_, ends, ["d"], "p"))))

    plain = both()
    monkeypatch.setattr(matching, "SPLIT_ROWS", 50)
    monkeypatch.setattr(matching, "STRETCHES", 16)
    assert both() == plain
    cuts = {r._k0: r._cuts for r in matching._stretches(probes, ["d"], "p").collect()}
    assert 1 in cuts and len(set(cuts[1])) == 15
    at = [r.p or 0 for r in probes.where("d = 1").collect()]
    sizes = [sum(lo < x <= hi for x in at) for lo, hi in zip([-1, *cuts[1]], [*cuts[1], 999], strict=True)]
    assert max(sizes) < len(at) / 5
    text_keys = lambda df: df.withColumn("d", F.col("d").cast("string")).withColumn("p", F.timestamp_seconds("p"))
    assert matching.asof_backward(text_keys(probes), text_keys(anchors_), ["d"], "p", "l").groupBy("l").count().count() >= 3


def test_fuzzy_names_meet_in_their_rarest_token(spark, monkeypatch):
    """Zipfian words: all pairs equal brute force, and few are compared."""
    rng = random.Random(11)
    words = ["de", "direito", "dir", "penal", "pen", "ii", "2", "bloco", "a", *(f"w{i}x{i % 7}" for i in range(150))]
    name = lambda: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randrange(1, 6)))
    left, right = sorted({name() for _ in range(300)}), sorted({name() for _ in range(300)} | {"De", "..."})
    same = lambda x, y: x == y or (not x.isdigit() and not y.isdigit() and min(len(x), len(y)) >= 2 and (x.startswith(y) or y.startswith(x)))

    def match(a, b):
        x, y = ([text.ROMAN.get(t, t) for t in text.fold_text(n).split()] for n in (a, b))
        s, t = (x, y) if len(x) <= len(y) else (y, x)
        return bool(s) and any(all(map(same, s, t[i:])) for i in range(len(t) - len(s) + 1))

    a, b = (spark.createDataFrame([(n,) for n in names], "m string") for names in (left, right))
    expected = sorted((x, y) for x in left for y in right if match(x, y))
    for bound in (1000, 5):
        monkeypatch.setattr(matching, "BLOCK_NAMES", bound)
        assert sorted(map(tuple, matching.matching_names(a, "m", b, "m").collect())) == expected
    compared = matching.candidate_names(matching._worded(a, "m"), matching._worded(b, "m")).count()
    assert len(expected) <= compared < 3 * len(expected) < len(left) * len(right) / 8


def test_hot_blocks_of_names_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_NAMES", 50)
    index = spark.createDataFrame([(f"n{i}", "=de") for i in range(900)] + [("m", "=x")], "long string, key string")
    probes = spark.createDataFrame([("p", "=de"), ("q", "=x"), ("r", "=y")], "short string, key string")
    often = index.groupBy("key").agg(F.count("*").alias("rows"))
    met = matching._dealt(probes, index, often)
    assert met.count() == 901 and met.where("short = 'p'").distinct().count() == 900
    assert "hashpartitioning(key" in met._jdf.queryExecution().toString() and ", block" in met._jdf.queryExecution().toString()


def test_zip(spark):
    a = spark.createDataFrame([(1, i) for i in range(3)], "d int, o int")
    assert matching.zip_positional(a, a.where("o < 2"), ["d"], "o").count() == 2
    assert rows(matching.zip_mismatches(a, a.where("o < 2"), ["d"])) == [(1, 3, 2)]


def KEEP(df, name):  # noqa: N802
    """Writes rows once, as a table would."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


DRAFT = "i int, enunciado string, comentario string, resposta string, resolucao string, alternativas map<string,string>, gabarito string, formato string, materia string, trecho string"


def test_decisions(spark):
    product, form = generation.product_format("mestre_questoes")
    assert form == "certo_errado" and generation.product_format("revisao_farol")[1] is None
    with pytest.raises(generation.UnknownProduct):
        generation.product_format("mestre_questoes", "essay")
    drafts = spark.createDataFrame(
        [
            (0, "s", "no quote", None, "2+2", None, "C", "certo_errado", "M", "t"),
            (1, "s", '"absent"', None, None, None, "C", "certo_errado", "M", "t"),
            (2, "s", '"t" o trecho informa', None, None, None, "C", "certo_errado", "M", "t"),
            (3, "s", '"t"', None, None, None, "C", "certo_errado", "M", "t"),
            (4, "s", '"t"', None, None, None, "E", "certo_errado", "M", "t"),
        ],
        DRAFT,
    )
    out = generation.judge_drafts(drafts, product, KEEP, lambda d: d.withColumn("key_ok", ~F.col("i").isin(0, 4)))
    assert sorted(rows(out, "i", "status", "motivo_rejeicao")) == [(0, "rejeitada", "key"), (1, "rejeitada", "quotation"), (2, "rejeitada", "source"), (3, "pendente_revisao", None), (4, "rejeitada", "key")]
    twice = generation.generate_twice(drafts.select("i").where("i in (2, 3)"), lambda r: drafts.join(r, "i", "left_semi"), KEEP)
    assert sorted(rows(twice, "i", "attempt")) == [(2, 2), (3, 1)]
    summary = generation.batch_summary(out.withColumn("error", F.when(F.col("i") == 3, "x")))
    assert rows(summary) == [(0, 4, 1)]


def test_listing_and_filters(spark):
    df = spark.createDataFrame([(1, "Ab_c", "x" * 201), (2, "abxc", None)], "id int, n string, t string")
    assert rows(df.where(catalog.same_text("n", "AB_C")), "id") == [(1,)]
    assert catalog.where_given(df, equal={"n": ""}, same={"n": None}, among={"id": []}).count() == 2
    assert rows(catalog.listing(df, ["id"], sizes={"t": "size"}), "id", "size") == [(1, 201), (2, 0)]
    assert len(rows(catalog.listing(df, ["id"], short={"t": 200}), "t")[0][0]) == 203


def test_generators_run_once_for_each_request_and_attempt(spark, tmp_path):
    """A random generator that counts its calls: no draft is made twice, lost or doubled."""
    log = str(tmp_path)

    def make(request):
        attempt = uuid.uuid4().hex
        with open(f"{log}/{request['i']}-{attempt}", "w"):
            pass
        if request["i"] == 3:
            raise RuntimeError("no answer")
        named = request["i"] % 2 == 0 and len([n for n in os.listdir(log) if n.startswith(f"{request['i']}-")]) == 1
        return {"enunciado": f"{attempt} o trecho informa" if named else attempt, "formato": "certo_errado", "gabarito": "C"}

    requests = spark.createDataFrame([(i, "M") for i in range(10)], "i int, materia string")
    seam = generation.per_request(make, "enunciado string, comentario string, resposta string, resolucao string, alternativas map<string,string>, gabarito string, formato string, trecho string")
    product, _ = generation.product_format("revisao_farol")
    keep = lambda df, name: files.replace_table(df, f"{tmp_path}/t/{name}")
    out = generation.judge_drafts(generation.generate_twice(requests, seam, keep), product, keep)
    for _ in range(2):
        got = {r.i: r for r in out.collect()}
        assert set(got) == set(range(10)) and out.count() == 10
    calls = [n.split("-")[0] for n in os.listdir(log) if "-" in n]
    assert {i: calls.count(str(i)) for i in range(10)} == {i: 2 if i % 2 == 0 else 1 for i in range(10)}
    assert got[3].error == "RuntimeError: no answer" and got[3].status is None and all(got[i].attempt == 2 - i % 2 for i in range(10))
    assert rows(generation.batch_summary(out)) == [(9, 0, 1)]
    silent = generation.generate_twice(requests, lambda r: seam(r.where("i <> 5")), keep)
    assert rows(silent.where("i = 5"), "error") == [("no draft",)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_first_interval_on_many_partitions(spark, adaptive):
    rng = random.Random(1)
    points = [(rng.randrange(5), rng.randrange(40), "p") for _ in range(400)]
    spans = [(rng.randrange(5), lo := rng.randrange(40), lo + rng.randrange(6), o, f"s{o}") for o in range(60)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        found = matching.first_interval(spark.createDataFrame(points, "d int, at int, x string").repartition(8), spark.createDataFrame(spans, "d int, lo int, hi int, o int, v string").repartition(8), ["d"], "at", start="lo", end="hi", order="o", value="v")
        got = sorted(rows(found, "d", "at", "v"), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    first = lambda d, at: next((v for sd, lo, hi, _, v in spans if sd == d and lo <= at <= hi), None)
    assert got == sorted([(d, at, first(d, at)) for d, at, _ in points], key=str)


def test_last_change_wins(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    changes = spark.createDataFrame([(1, "x", 2), (1, "z", 3), (1, "y", 1), (2, None, 1)], "id long, v string, o int")
    assert sorted(rows(store.update_by_key(stored, changes, ["id"], ["v"], "o"), "id", "v", "matched"), key=str) == [(1, "z", True), (2, None, True)]
    assert sorted(rows(store.update_by_key(stored, changes.coalesce(1), ["id"], ["v"]), "id", "v"), key=str) == [(1, "y"), (2, None)]


@pytest.mark.parametrize("piece", [7, 10**6])
def test_numbering_has_no_gaps(spark, piece):
    df = spark.createDataFrame([(f"k{(i * 37) % 101:03}",) for i in range(101)], "k string").repartition(5)
    assert sorted(rows(draws.numbered(df, "k", "n", piece=piece))) == [(f"k{i:03}", i + 1) for i in range(101)]


def test_literal_matches_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 9)))
    passages = ["".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(80)] + [None, ""]
    quotes = [p[at : at + rng.choice((1, 2, 3, 5, 9, 17, 40, 70))] for p in passages[:60] if p for at in (rng.randrange(len(p)),)] + ["", None, "zzz", "ab" * 40]
    p = spark.createDataFrame(list(enumerate(passages)), "p int, t string").repartition(4)
    q = spark.createDataFrame(list(enumerate(quotes)), "q int, s string")
    key = lambda s: re.sub(r"\s+", "", s or "").upper()
    expected = [(i, j) for i, t in enumerate(passages) for j, s in enumerate(quotes) if key(s) and key(s) in key(t)]
    found = matching.literal_matches(p, "t", q, "s")
    assert sorted(rows(found, "p", "q")) == expected and len(expected) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_anchors_of_long_strings_take_few_rows(spark):
    """A quotation of a megabyte makes ``PICKS`` rows, and is found across chunks and batches."""
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefgh é", k=1_200_000))
    strings = spark.createDataFrame([(1, long[5:1_100_000]), (2, long[:70]), (3, "h"), (4, long[10:20] + "zz"), (5, "é")], "q int, s string")
    parts = [b for b in anchors._picked([pa.record_batch([pa.array(["k"] * 2), pa.array([long, "é"])], ["key", "string"])])]
    assert [b.num_rows for b in parts] == [anchors.PICKS + 1]
    texts = spark.createDataFrame([(1, "x" + long), (2, None), (3, ""), (4, "é"), (5, long[:75]), (6, "z" * 40)], "p int, t string").coalesce(1)
    assert sorted(rows(anchors.contained(texts, "t", strings, "s"), "p", "q")) == [(1, 1), (1, 2), (1, 3), (1, 5), (4, 5), (5, 2), (5, 3), (5, 5)]
    assert anchors.contained(texts, "t", strings.limit(0), "s").count() == 0 and anchors.contained(texts.limit(0), "t", strings, "s").count() == 0
    # Windows across two texts of a batch don't count.
    pair = spark.createDataFrame([(1, "ab"), (2, "cd")], "p int, t string").coalesce(1)
    assert anchors.contained(pair, "t", spark.createDataFrame([(1, "bc"), (2, "cd")], "q int, s string"), "s").count() == 1
