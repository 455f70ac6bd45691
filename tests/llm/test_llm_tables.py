"""Ranking, overlap and packing: against brute force and invariants."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmill import session
from parchmill.llm import overlap, packing, queries, ranking, sql

# ---- problem 3 ----


def lower_median(v):
    return sorted(v)[(len(v) - 1) // 2]


def combined(rows, weights):
    out = {}
    for g in {r[0] for r in rows}:
        part = [r for r in rows if r[0] == g and all(x is not None for x in r[2:])]
        total = {r[1]: 0.0 for r in part}
        for k, w in enumerate(weights):
            v = [r[2 + k] for r in part]
            m = lower_median(v)
            gaps = [abs(x - m) for x in v]
            scale = lower_median(gaps) * 1.4826 or statistics.fmean(gaps)
            for r in part:
                z = (r[2 + k] - m) / scale if scale else 0.0
                total[r[1]] += w / sum(weights) * math.log(1 / (1 + math.exp(-z)))
        out |= {(g, i): math.exp(t) for i, t in total.items()}
    return out


def test_ranking_equals_plain_python(spark):
    rng = random.Random(1)
    rows = [(g, f"r{g}{i:02d}", rng.random(), rng.randint(1, 5) * 1.0, rng.choice([None, *map(float, range(0, 1000, 7))])) for g in "ab" for i in range(15)]
    rows += [("c", "only", 0.5, 3.0, 1.0), ("d", "x", 1.0, 1.0, 1.0), ("d", "w", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "grid string, run string, p double, q double, s double")
    got = ranking.combined_scores(df, ["grid"], {"p": 1, "q": 2, "s": 1}).cache()
    want = combined(rows, [1, 2, 1])
    assert {(r.grid, r.run): pytest.approx(r.combined) for r in got.collect()} == want
    best = {r.grid: r.run for r in ranking.first_of_group(got, ["grid"], "run").collect()}
    for g in "abcd":
        top = max(v for (h, _), v in want.items() if h == g)
        assert best[g] == min(i for (h, i), v in want.items() if h == g and math.isclose(v, top, rel_tol=1e-12))


def test_unit_does_not_matter(spark):
    rng = random.Random(2)
    rows = [("g", f"r{i}", rng.random(), rng.random(), rng.random()) for i in range(12)]
    make = lambda f: spark.createDataFrame([(g, i, p, q, s * f) for g, i, p, q, s in rows], "g string, run string, p double, q double, s double")
    w = {"p": 1, "q": 1, "s": 1}
    a, b = ({r.run: round(r.combined, 9) for r in ranking.combined_scores(make(f), ["g"], w).collect()} for f in (1, 1e6))
    assert a == b


def test_nothing_null_groups_nan_and_infinite_gaps(spark):
    df = spark.createDataFrame([(None, "a", 1.0), (None, "b", float("nan")), ("g", "c", 1e300), ("g", "d", -1e300), ("g", "e", 0.0)], "g string, run string, p double")
    got = {r.run: r.combined for r in ranking.combined_scores(df, ["g"], {"p": 1}).collect()}
    assert set(got) == {"a", "c", "d", "e"} and got["a"] == 0.5 and got["c"] > got["e"] > got["d"] and all(0 <= v <= 1 for v in got.values())
    assert ranking.combined_scores(df.limit(0), ["g"], {"p": 1}).isEmpty()
    with pytest.raises(ValueError):
        ranking.combined_scores(df, ["g"], {"p": 0})


def test_run_scores_count_a_row_once_and_skip_null(spark):
    rubric = spark.createDataFrame([("r", "1", 0.2), ("r", "1", 0.2), ("r", "2", 0.4), ("r", "3", None)], "run_id string, id string, aggregate double")
    judge = spark.createDataFrame([("r", 4.0, 0.5), ("r", 4.0, 0.5)], "run_id string, overall double, groundedness double")
    runs = spark.createDataFrame([("r", "g"), ("r", "g"), ("x", "g")], "run_id string, grid_id string")
    assert [(r.run_id, round(r.aggregate, 9), r.overall) for r in ranking.run_scores(rubric, judge, runs).collect()] == [("r", 0.3, 4.0)]


# ---- problem 6 ----


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


VOCABULARY = [f"w{k}" for k in range(400)]


def edits(rng, w, n):
    w = list(w)
    for k in rng.sample(range(len(w)), n):
        w[k] = f"z{rng.randint(0, 10**9)}"
    return w


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_difference_equals_brute_force():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        most = rng.randint(0, 6)
        assert overlap.difference(a, b, most) == min(distance(a, b), most + 1)


def test_difference_of_long_texts_is_quick():
    rng = random.Random(12)
    text = words(rng, 30_000)
    assert overlap.difference(text, edits(rng, text, 900), 6_000) == 900


def test_words_are_those_of_any_layout():
    assert overlap.words_of("Co-branded CAR-\n tons, re\u00adturned;\tdon’t 5 été") == ["cobranded", "cartons", "returned", "dont", "5", "été"]
    assert overlap.words_of(" \n-' ") == []


def test_starts_of_near_texts_meet():
    rng = random.Random(2)
    counts = np.full((2, overlap.BUCKETS), 5, np.uint32)
    for n in [*range(8, 40), 77, 200, 3000]:
        text = words(rng, n)
        texts = [text, edits(rng, text, n // 5)]
        owner, key, _, place, *_ = overlap.starts(texts, np.array([1, 2]), counts)
        met = {(k, p) for k, p, o in zip(key, place, owner) if o == 0} & {(k, p) for k, p, o in zip(key, place, owner) if o == 1}
        assert met, n


def test_coverage_merges_the_passages():
    a, b = "u a b c d x e f g".split(), "a b c d y e f g v w".split()
    assert overlap.coverage(a, b, [(1, 0), (2, 1), (6, 5)]) == (7 / 9, 7 / 10)
    assert overlap.coverage(a, a, [(0, 0), (4, 4)]) == (1.0, 1.0) and overlap.coverage(a, b, []) == (0.0, 0.0)


def test_overlap_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"t{i:03d}", words(rng, rng.randint(8, 60)), "train") for i in range(120)]
    for i in range(60):
        base = rows[rng.randint(0, 119)][1]
        rows.append((f"v{i:03d}", edits(rng, base, int(len(base) * rng.choice([0, 0.05, 0.1, 0.3, 0.5]))), rng.choice(["valid", "test"])))
    hot = words(rng, 40)
    rows += [(f"h{i:02d}", edits(rng, hot, 2 * (i % 3 == 0)), "train" if i % 2 else "test") for i in range(40)]
    want = {(a, b) for a, x, s in rows for b, y, t in rows if s == "train" != t and distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9}
    shown = [(k, " ".join(w).upper().replace(" ", rng.choice([" ", "  ", "\n", ", "])), s) for k, w, s in rows]
    df = spark.createDataFrame(shown + shown[:20] + [("n", None, "train"), ("e", "", "test"), ("k", "too few", "test"), ("q", shown[0][1], None)], "id string, clause_text string, split string")
    got = {tuple(r) for r in overlap.overlapping(df.withColumn("words", F.lit("x"))).collect()}
    assert got == want


def test_hyphens_and_breaks_do_not_count(spark):
    a = "The sealed cartons are co-branded and must be returned within ten days after the second notice"
    b = "THE SEALED CAR-\n TONS are cobranded, and must be re­turned; within ten days after the \"second\" notice."
    df = spark.createDataFrame([("a", a, "train"), ("b", b, "test")], "id string, clause_text string, split string")
    assert [tuple(r) for r in overlap.overlapping(df).collect()] == [("a", "b")]
    assert overlap.overlapping(df.limit(0)).isEmpty()


def test_a_hot_passage_is_split_and_loses_nothing(spark):
    rng = random.Random(4)
    common = words(rng, 20)
    rows = [(f"x{i:03d}", " ".join(common + words(rng, 30)), "train" if i % 2 else "test") for i in range(300)]
    twin = common + words(rng, 30)
    rows += [("a", " ".join(twin), "train"), ("b", " ".join(edits(rng, twin, 5)), "valid")]
    df = spark.createDataFrame(rows, "id string, clause_text string, split string")
    assert [tuple(r) for r in overlap.overlapping(df).collect()] == [("a", "b")]


def brute_overlap(rows):
    return {(a, b) for a, x, s in rows for b, y, t in rows if s == "train" != t and distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9}


def found_overlap(spark, rows):
    df = spark.createDataFrame([(k, " ".join(w), s) for k, w, s in rows], "id string, clause_text string, split string")
    return {tuple(r) for r in overlap.overlapping(df).collect()}


def test_every_partner_behind_a_common_passage_is_found(spark):
    rng = random.Random(7)
    common, rows = words(rng, 16), []
    for f in range(30):  # families that share only the passage, with members of unequal length between them
        tail = words(rng, 24)
        rows += [(f"t{f:02d}{k}", common + edits(rng, tail, 3 * k), "train") for k in range(3)]
        rows += [(f"v{f:02d}{k}", common + edits(rng, tail, 2 * k), "valid") for k in range(3)] + [(f"z{f:02d}", common + words(rng, 1 + f), "test")]
    want = brute_overlap(rows)
    assert len(want) >= 200 and found_overlap(spark, rows) == want


def test_edits_up_to_the_limit_are_found_at_every_length(spark):
    rng = random.Random(8)
    rows = []
    for i, n in enumerate([*range(8, 34), 40, 60, 85, 120, 200] * 6):
        text = words(rng, n)
        rows += [(f"t{i:03d}", text, "train"), (f"v{i:03d}", edits(rng, text, n // 5), "test")]
    want = brute_overlap(rows)
    assert len(want) >= 180 and found_overlap(spark, rows) == want


def test_splitting_hot_keys_keeps_every_link(spark):
    rng = random.Random(10)
    common = words(rng, 20)
    rows = [(f"x{i:03d}", " ".join(edits(rng, common, 2)), "train" if i % 2 else "test") for i in range(200)]
    df = spark.createDataFrame(rows, "id string, clause_text string, split string")
    _, counts = overlap.scanned(df, "id")
    assert counts.sum() == 200 * 19 and overlap.grid(counts).max() == 1

    def linked(c):
        return {(r.a, r.b) for r in overlap.links(df, c).collect()}

    hot = np.where(counts > 0, 5 * overlap.CELL, 0).astype(np.uint32)  # as if all keys were hot
    assert overlap.grid(hot).max() == 5
    assert len(linked(counts)) == 10_000 and linked(hot) == linked(counts)


def test_short_and_evenly_edited_pairs_are_found(spark):
    rng = random.Random(11)
    rows = []
    for n, at in ((8, [3]), (10, [5]), (12, [6]), (40, range(5, 40, 6)), (60, range(6, 60, 7)), (60, range(11, 60, 12))):
        for i in range(30):
            text = words(rng, n)
            rows += [(f"t{n}{len(at)}-{i}", text, "train"), (f"v{n}{len(at)}-{i}", [f"z{rng.random()}".replace(".", "") if k in at else w for k, w in enumerate(text)], "test")]
    assert len(found_overlap(spark, rows)) == 180


def test_thresholds_try_only_ranks_that_stand_there(monkeypatch):
    rng = np.random.default_rng(14)
    rank = rng.integers(0, 1 << 30, (60, 9)).astype(np.int32)
    rank[50:, 3:] = np.iinfo(np.int32).max
    need, tried, apart = np.arange(1, 10) * 4, [], overlap._apart
    want = []
    for k in range(9):
        enough = [r for r in sorted(rank[:, k].tolist()) if apart((rank <= r)[:, k : k + 1])[0] >= need[k]]
        want.append(min([*enough, np.iinfo(np.int32).max - 1]))
    monkeypatch.setattr(overlap, "_apart", lambda taken: tried.append(1) or apart(taken))
    assert overlap.thresholds(rank, need).tolist() == want
    assert len(tried) <= 7


def test_suffixes_delivered_again_give_one_link_and_places_stay():
    text = [f"w{k}" for k in range(20)]
    other = [*text[:10], "new", *text[11:]]
    keys = np.concatenate([overlap.pair_keys(overlap.word_numbers([t])) for t in (text, other)])
    counts = np.zeros((2, overlap.BUCKETS), np.uint32)
    counts[:, overlap.bucket(keys)] = 1
    rows = overlap.pd.DataFrame({"text": [" ".join(text), " ".join(other)], "side": [1, 2]})
    once = overlap.pd.concat(overlap._emit(counts)(iter([rows])))

    def linked(n):
        given = overlap.pd.concat([once] * n).sort_values("first", kind="stable")
        return sorted(r for b in overlap._linked(iter([given])) for r in b.itertuples(index=False, name=None))

    assert linked(1) and linked(3) == linked(1) and len(set(linked(1))) == len(linked(1))
    links = overlap.pd.DataFrame(linked(1), columns=[*"abijk"])
    (pair,) = overlap.pd.concat(overlap._together(iter([links[:1], links[1:]]))).itertuples(index=False)
    assert overlap.places_of(pair.spans) == sorted({(r.i, r.j) for r in links.itertuples()})
    assert not list(overlap._together(iter([links.assign(k=len(links) + 1)])))


def test_words_beyond_ascii_are_told_as_by_category():
    texts = ["".join(map(chr, range(k, k + 50))) for k in range(0, 0x30000, 50) if not 0xD7CE <= k <= 0xDFFF]
    assert [overlap._plain(t) for t in texts] == [t.translate(overlap._PLAIN) for t in texts]


def test_coverage_by_record_counts_equal_and_near_texts(spark):
    rng = random.Random(13)
    text, other = words(rng, 20), words(rng, 20)
    rows = [("t1", text, "train"), ("t2", other, "train"), ("v1", text, "valid"), ("v1", text, "valid"), ("v2", [*other[:10], "new", *other[11:]], "test"), ("v3", words(rng, 20), "test")]
    df = spark.createDataFrame([(k, " ".join(w), s) for k, w, s in rows], "id string, clause_text string, split string")
    assert {r.key: r.coverage for r in overlap.covered(df).collect()} == {"v1": 1.0, "v2": 0.95}
    assert overlap.covered(df.limit(0)).isEmpty()


# ---- problem 8 ----


def test_best_fit_is_within_capacity_and_tight():
    rng = random.Random(5)
    items = [f"i{k}" for k in range(3000)]
    sizes = [rng.choice([0, 1, 3, 100, 250, 700, 1024]) for _ in items]
    name, fill = packing.best_fit(items, sizes, 1024)
    assert max(fill.values()) <= 1024 and sum(fill.values()) == sum(sizes) and len(name) == 3000
    assert len(fill) <= math.ceil(sum(sizes) / 1024) * 11 / 9 + 1


def test_containers_hold_every_item_once(spark):
    rng = random.Random(6)
    sizes = [0, 0, 1024, 1025, 5000, None, *[rng.randint(1, 900) for _ in range(2000)]]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n bigint").withColumn("container", F.lit("x")).repartition(70)
    got = packing.fill_containers(df, "doc_id", "n", 1024).collect()
    by, fill = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        fill[r.container] = fill.get(r.container, 0) + r["size"]
    assert len(by) == len(sizes) and max(fill.values()) <= 1024
    for d, n in enumerate(sizes):
        p = sorted(by[d], key=lambda r: r.piece)
        assert sum(r["size"] for r in p) == (n or 0) and len(p) == max(1, math.ceil((n or 0) / 1024)) and [r.start for r in p] == [1024 * k for k in range(len(p))]
    assert len(fill) <= 1.02 * sum(n or 0 for n in sizes) / 1024 + 1


def test_containers_that_take_no_more_climb_no_further(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(packing, "written", lambda df, label: seen.append(label) or session.written(df, label))
    half = spark.range(5000).select("id", (F.col("id") % 100 + 600).alias("n")).repartition(40)
    assert packing.fill_containers(half, "id", "n", 1024).select("container").distinct().count() == 5000 and "merged" not in seen
    monkeypatch.setattr(packing, "ROUND_ROWS", 50)
    mixed = spark.range(2000).select("id", (F.col("id") % 7 * 60 + 40).alias("n")).repartition(30)
    got = packing.fill_containers(mixed, "id", "n", 1024)
    fill = [r.f for r in got.groupBy("container").agg(F.sum("size").alias("f")).collect()]
    assert max(fill) <= 1024 and sum(fill) == mixed.agg(F.sum("n")).first()[0] and len(fill) <= 1.02 * sum(fill) / 1024 + 1


def test_nothing_and_only_empties(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, n bigint")
    assert packing.fill_containers(df.limit(0), "doc_id", "n").isEmpty()
    assert len({r.container for r in packing.fill_containers(df, "doc_id", "n").collect()}) == 1
    with pytest.raises(ValueError):
        packing.fill_containers(df, "doc_id", "n", 0)


def test_every_problem_has_its_query():
    names = queries.queries()
    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_ids", "p8_containers", "p9_found"} <= set(names)
    assert set(sql.sql()) <= set(names)
