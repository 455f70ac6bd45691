"""Quality, repetition, defects, truncation, encoding and sentences: rules against cases and brute force."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parchmill.llm import defects, encoding, lexicon, quality, queries, repetition, sentences, truncation

PROSE = "The Carrier shall deliver the sealed goods within ten days after the notice, and the Buyer must pay the agreed price."
TABLE = "| Item | Fee |\n| sealed kegs | 12.50 |\n| woven maps | 33 % |\n| old dies | 1,204 |"
LIST = "Covered items:\n- sealed kegs\n- woven maps (Ambreth)\n- old dies\n- keys of the maps at Quellby"


# ---- problem 1 ----

KINDS = {
    PROSE: "prose", PROSE.upper(): "prose", PROSE.replace(" ", "\n", 9): "prose", "(a) " + PROSE + "\n(b) " + PROSE: "prose",
    "Intentionally omitted.": "prose", "See Annex 3": "prose", TABLE: "table", "Item\tFee\tCap\nsealed kegs\t12.50\t7\nwoven maps\t33 %\t9": "table",
    LIST: "list", "sealed kegs, woven maps, old dies, 12 red boxes, Acme Ltd., blue tins": "list",
    "6c e4 bc e6 66 f1 0f 9b 94 52 1a 32 e6 d7": "junk", "riexvvotf npqocigbawi hmbwhqfo sr lnfgswk fgrndmucvau jqkidln xrmwdgm zz": "junk",
    "<div class=\"x\"><span id=\"y\"></span></div>&nbsp;&nbsp;<br/>": "junk", "{n_l> <;±}¦] ,*{§[§0r l*§ l.[ I~O=^¬ : O1}/O o#": "junk",
    "": "empty", " \n\t ": "empty",
}


def test_kinds(spark):
    rows = [(i, t) for i, t in enumerate([*KINDS, None])]
    df = spark.createDataFrame(rows, "id int, clause_text string").withColumn("kind", F.lit("x")).withColumn("__t", F.lit(1))
    got = {r.id: r.kind for r in quality.with_kind(df).collect()}
    assert [got[i] for i, _ in rows] == [*KINDS.values(), "empty"]


def test_published_rules_tell_a_reason_each(spark):
    texts = {"- a bc\n- d ef\n- g hi": "bullet lines", "so it goes...\nand on...": "ellipsis lines", "# a # b # c": "symbols to words", "12 13 14 15 16 of the": "alphabetic words",
             "xylograph zyzzyva quokka": "stop words", "the end of it": "no line ends in a mark", "of the antidisestablishmentarianism": "mean word length"}
    rows = {r.t: r.warnings for r in quality.with_kind(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    assert all(want in rows[t] for t, want in texts.items()), rows
    long = "The Buyer shall pay the agreed price to the Seller within ten days of the notice. " * 5
    assert quality.with_kind(spark.createDataFrame([(long,)], "t string"), "t").first().warnings == []


def test_statistics_and_reasons(spark):
    df = spark.createDataFrame([(PROSE,), ("x" * 200_000,), (None,)], "clause_text string")
    rows = quality.with_kind(df).collect()
    s = rows[0].stats
    assert s.n_words == len(re.findall(r"[^\W\d_]+", PROSE)) and s.n_lines == 1 and s.line_end_share == 1 and rows[0].reasons == []
    assert rows[1].reasons and rows[2].stats.n_chars == 0
    assert quality.with_kind(df.limit(0)).isEmpty()


def test_quality_by_category_evens_spelling(spark):
    df = spark.createDataFrame([("1", "Cap ", PROSE), ("2", "CAP", LIST), ("3", None, TABLE)], "id string, category string, clause_text string")
    got = {r.category: (r.n, r.n_prose, r.n_list, r.n_table) for r in quality.by_category(quality.with_kind(df)).collect()}
    assert got == {"cap": (2, 1, 1, 0), None: (1, 0, 0, 1)}


# ---- problem 2 ----


def brute_covered(words, n, times):
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    hit = set()
    for i, g in enumerate(grams):
        if sum(h == g for h in grams) >= times:
            hit.update(range(i, i + n))
    return len(hit)


def test_covered_equals_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        assert repetition.covered(words, 4) == [brute_covered(words, 4, 3), brute_covered(words, 4, 2)]


@pytest.mark.parametrize(
    ("text", "share"),
    [
        ("map " * 30, 1.0), ("1. The fee is due now. 2. THE FEE IS DUE NOW! 3. the fee, is due now", 1.0), ("Yes. No. Yes. Go. Yes. Yes. Yes.", 5 / 7),
        (PROSE, 0.0), (PROSE + " " + PROSE, 0.0), ("", 0.0), (None, 0.0), ("  ", 0.0),
    ],
)
def test_repeated_share(text, share):
    assert repetition.statistics(text)[2] == pytest.approx(share, abs=0.01)


def test_outliers_find_the_loops_in_every_group(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta kappa sigma omega theta lambda the of and to shall".split()
    rows = [(f"p{i}", "s1" if i % 3 else "s2", " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(60)) + " the of and shall") for i in range(300)]
    rows += [(f"x{i}", "s1", "the shall " * 30) for i in range(30)] + [("n1", None, None), ("n2", "s2", ""), ("y", "lone", "the fee of a kind is due " * 9)]
    got = repetition.repetitive(spark.createDataFrame(rows + rows[:5], "id string, source string, t string"), "t", "id")
    hit = {r.id for r in got.where("repetitive").collect()}
    assert hit == {f"x{i}" for i in range(30)} | {"y"} and got.count() == len(rows) + 5


def test_outliers_of_equal_rows_and_of_nothing(spark):
    same = spark.createDataFrame([(str(i), "s", PROSE) for i in range(60)], "id string, source string, t string")
    assert repetition.repetitive(same, "t", "id").where("repetitive").isEmpty()
    assert repetition.repetitive(same.limit(0), "t", "id").isEmpty()


@pytest.mark.parametrize("share", [0.5, 0.6, 1.0])
def test_loops_that_fill_their_group_are_found(spark, tmp_path, share):
    rng = random.Random(9)
    rows = []
    for i in range(200):
        loop = i < 200 * share
        phrase = " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(5, 9)))
        rows.append((f"{'x' if loop else 'p'}{i:03d}", "s", (phrase + ". ") * rng.randint(4, 9) if loop else " ".join(f"w{rng.randint(0, 999)}" for _ in range(50))))
    df = spark.createDataFrame(rows, "response_id string, source string, raw_response string")
    want = {k for k, *_ in rows if k[0] == "x"}
    assert {r.response_id for r in repetition.repetitive(df, "raw_response", "response_id").where("repetitive").collect()} == want
    df.write.parquet(f"{tmp_path}/analyze_responses.parquet")
    assert {r.response_id for r in queries.p2_found(spark, str(tmp_path)).collect()} == want


# ---- problems 4 and 5 ----


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    who, what, when = ["Carrier", "Buyer", "Agent"], ["sealed goods", "woven maps", "vessels"], ["the annual notice", "the final delivery", "the first inspection"]
    return truncation.TerminalModel.fit(
        f"The {rng.choice(who)} shall deliver the {rng.choice(what)} before {rng.choice(when)}. The {rng.choice(who)} may keep the {rng.choice(what)} until {rng.choice(when)}."
        for _ in range(300)
    )


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        ("The Carrier shall deliver the sealed goods before the annual notice.", False), ("The Carrier shall deliver the woven maps before the annual notice", False),
        ("The Carrier shall deliver the woven maps before the ann", True), ("The Carrier shall deliver the", True), ("The Buyer may keep the vess", True),
        ("The Carrier shall deliver the sealed go…", True), ("The Carrier shall deliver [...]", True), ("The Carrier shall de-", True),
        ("The Buyer may keep all.”", False), ("", False), ("...", False), ("Issue:\n\nRule:", False), ("Conclusion: N/A", False),
    ],
)
def test_cut(model, text, cut):
    assert model.is_cut(text) is cut


def test_a_limit_or_brevity_decides_where_words_do_not(model):
    t = "The Carrier shall deliver the woven maps before the annual notice"
    assert model.is_cut(t, at_limit=True) and not model.is_cut("Notices", long=False)


def test_limits_are_spikes_at_the_upper_end(spark):
    rng = random.Random(2)
    rows = [("f", "a", "x" * rng.randint(50, 300)) for _ in range(1500)] + [("f", "a", "x" * 300)] * 200 + [("f", "b", "x" * rng.randint(50, 300)) for _ in range(600)]
    rows += [("f", "c", "ü" * 100 + "x" * k) for k in range(50)] + [("f", "a", None), ("f", None, "")]
    got = {(r.source, r.unit, r["size"]) for r in truncation.limits(truncation.lengths(spark.createDataFrame(rows, "field string, source string, text string"))).collect()}
    assert got == {("a", "chars", 300), ("a", "bytes", 300)}


def test_cut_texts_leave_lists_tables_and_null_alone(spark, model):
    long = "The Carrier shall deliver the sealed goods before the annual notice. The Buyer may keep the vess"
    rows = [("f", "s", "1", long), ("f", "s", "1", long), ("f", None, "2", long), ("f", "s", "3", TABLE), ("f", "s", "4", LIST), ("f", "s", "5", None), ("f", "s", "6", "")]
    df = spark.createDataFrame(rows, "field string, source string, key string, text string")
    assert {r.key for r in truncation.cut_texts(df, {"f": model}).collect()} == {"1", "2"}
    assert truncation.cut_texts(df.limit(0), {"f": model}).isEmpty()


CLAUSE = "The Carrier shall deliver the sealed goods before the annual notice. The Buyer may keep the woven maps until the final delivery."
ANSWER = (
    "Issue: Does the clause let the Carrier wait?\n\nRule: As a rule, a term is read in its plain sense.\n\n"
    'Application: The text says "shall deliver the sealed goods", which is a duty.\n\nConclusion: The Carrier has to act before the annual notice.'
)


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (ANSWER, []), (ANSWER[:-1], []), (ANSWER + "\n\nI cannot speak to facts outside the clause.", []), (None, ["empty"]), ("  ​", ["empty"]), ("Issue:\n\nRule:", ["empty"]), ("N/A", ["empty"]),
        (ANSWER[:-28], ["truncated"]), ("I'm sorry, but I can't help with this request.", ["refusal"]), ("Es tut mir leid, aber ich kann diese Klausel nicht prüfen.", ["refusal", "other_language"]),
        (CLAUSE, ["copy"]), ("Analyze this clause using IRAC format. " + CLAUSE.upper(), ["copy"]), ("Issue: " + CLAUSE, ["copy"]), ('"' + CLAUSE + '"\n\n' + ANSWER, []),
        ("Frage: Der Händler muss die Ware nicht liefern.\n\nRegel: Die Frist ist mit der Zustellung gewahrt und nicht vor dem Ende.", ["other_language"]),
        ("问题: 运营方必须包装未付发票并自行承担费用。", ["other_language"]),
    ],
)
def test_defects(model, answer, want):
    assert defects.defects(answer, CLAUSE, False, model) == want


def test_defects_with_nothing_to_compare_with(spark, model):
    df = spark.createDataFrame([("1", ANSWER, None, None), ("2", None, None, False), ("3", ANSWER, "", True)], "id string, raw_response string, clause_text string, at_limit boolean")
    assert {r.id: r.defects for r in defects.with_defects(df, model).collect()} == {"1": [], "2": ["empty"], "3": []}
    assert defects.with_defects(df.limit(0), model).isEmpty()


DECLINED = "I'm sorry, but I can't help with this request."


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (" ".join([DECLINED] * 12), ["refusal"]), (DECLINED + " The Carrier shall deliver the", ["truncated", "refusal"]), (DECLINED + " The Buyer may keep the vess", ["truncated", "refusal"]),
        ("Issue: " + DECLINED + "\n\nRule: N/A\n\nConclusion: N/A", ["refusal"]), (" ".join([ANSWER] * 4) + " I cannot speak to facts outside the clause.", []),
    ],
)
def test_refusals_of_any_length_and_cut_ones(model, answer, want):
    assert defects.defects(answer, CLAUSE, False, model) == want


def test_a_null_source_has_its_limits(spark):
    responses = spark.createDataFrame([("1", "q", None, "x" * 30), ("2", "q", None, "x" * 31), ("3", "q", "a", "x" * 30), ("4", "q", "b", "x" * 31), ("5", "q", None, None)], "response_id string, id string, source string, raw_response string")
    requests = spark.createDataFrame([("q", CLAUSE)], "id string, clause_text string")
    limits = spark.createDataFrame([("raw_response", None, "chars", 30), ("raw_response", "b", "bytes", 31)], "field string, source string, unit string, size int")
    assert {r.response_id: r.at_limit for r in defects.answered(responses, requests, limits).collect()} == {"1": True, "2": False, "3": False, "4": True, "5": False}


def test_language():
    assert [lexicon.language(t) for t in ("the fee is due and shall be paid", "der Preis ist nicht mit der Ware", "le prix est dans la clause", "el precio no es para los", "料金は支払う", "合同第十条", "цена договора", "xyz", "")] == [
        "en", "de", "fr", "es", "ja", "zh", "ru", "und", "und",
    ]


# ---- problem 7 ----


@pytest.fixture(scope="module")
def encoder():
    return encoding.encoder()


TEXTS = ["", " ", "\n\n", "Hello  world's 12,345 <|endoftext|>", "naïve café ́e 料金は2.9%である 🧾👩‍💼", "x" * 3000, "a\r\n\tb  c", "ผู้ขนส่งจะตรวจสอบ", "\x00\x0b�"]


def test_encoding_equals_the_library(encoder):
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=encoding.SPLIT_PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    for t in TEXTS:
        ids = encoder.encode(t)
        assert ids == other.encode_ordinary(t) and encoder.count(t) == len(ids)
        assert b"".join(encoder.token[i] for i in ids).decode() == t
    for data in ("internationalisation", "料金" * 20):
        raw, last = data.encode(), []
        for k in range(1, len(raw) + 1):  # appended byte by byte, each prefix stays a valid encoding
            encoder.extend(raw[:k], last)
        assert encoder.read(last) == encoder.read(encoder.extend(raw, []))


def test_edits_equal_encoding_anew(encoder):
    rng = random.Random(4)
    for t in TEXTS:
        e = encoding.Encoding(encoder, t)
        for _ in range(30):
            a = rng.randint(0, len(e.text))
            b = min(len(e.text), a + rng.randint(0, 4))
            e.edit(a, b, rng.choice(["", " ", "'s", "ab", "\n ", "7", "é", "  x"]))
            assert e.ids == encoder.encode(e.text)
    with pytest.raises(ValueError):
        e.edit(5, 2, "")


def test_an_edit_encodes_few_pieces_anew(encoder):
    e = encoding.Encoding(encoder, "one two three four five " * 400)
    assert e.edit(4000, 4001, "Z") <= 6


def test_ids_of_null_and_empty_and_of_a_column_named_ids(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (3, " ", "x")], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encoding.with_ids(df).collect()}
    assert got[1] == got[2] == [] and got[3] == [220]
    assert {r.doc_id for r in encoding.one_per_id(df).collect()} == {1, 2, 3} and encoding.with_ids(df.limit(0)).isEmpty()


def test_null_ids_and_unequal_texts_of_one_id_keep_their_rows(spark, tmp_path):
    rows = [(None, "one"), (None, "two words"), (None, "one"), (5, "five"), (5, "six is more"), (6, None), (6, ""), (7, "five"), (7, "five")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = [(r.doc_id, tuple(r.ids)) for r in queries.p7_ids(spark, str(tmp_path)).collect()]
    e = encoding.encoder()
    assert sorted(ids, key=str) == sorted(((i, tuple(e.encode(t))) for i, t in set(rows)), key=str)
    packed = [(r.doc_id, r["size"]) for r in queries.p8_containers(spark, str(tmp_path)).collect()]
    assert sorted(packed, key=str) == sorted(((i, len(e.encode(t))) for i, t in set(rows)), key=str)


# ---- problem 9 ----


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(6)
    texts = []
    for _ in range(300):
        a, b = rng.choice(["The Buyer", "Mr. Lund", "Each Agent", "Acme Inc."]), rng.choice(["waits.", "pays No. 7 now.", "keeps it, e.g. the maps.", "left."])
        texts.append(f"{a} {b} The Seller acts. Under Art. 5 it ends.\n\nThe Agent v. Carrier case rests. {a} {b}")
    thai = ["ผู้ซื้ออาจโอนแคตตาล็อก ผู้ขายจะทำลายใบแจ้งหนี้", "ที่ปรึกษาจะขายแม่พิมพ์เก่า ผู้ซื้อต้องเปลี่ยนแคตตาล็อก"] * 20
    return sentences.SentenceModel.fit(texts + thai)


def parts(text, tagger):
    s = sentences.unit_starts(text, tagger)
    return [text[a:b].strip() for a, b in zip(s, [*s[1:], len(text)])]


@pytest.mark.parametrize(
    "want",
    [
        ["Mr. Lund waits.", "The Agent pays No. 7 now."], ["Is it late?", "No!!", "The Buyer waits… but not long."], ['He asked "Is this final?" and left.', "Then it ended."],
        ['The notice read, "The fee is late. Cure it now."', "The Buyer paid."], ["(See Annex B, p. 4, for more.)", "The Buyer paid."], ["The rate is 3.5 per cent.", "88 days later it rose."],
        ["Acme Inc. shall pay.", "The Seller acts."], ["通知写道：“卖方有权销毁。期限不变。”", "买方可以投保。"], ["通知には「期限は変わらない。」とある。", "買主は検査する。"],
        ["ผู้ซื้ออาจโอนแคตตาล็อก", "ผู้ขายจะทำลายใบแจ้งหนี้"], ["¿Puede pagar?", "¡No puede!"],
    ],
)
def test_units(tagger, want):
    joined = ("" if re.search(r"[一-鿿]", want[0]) else " ").join(want)
    assert parts(joined, tagger) == want


def test_lines(tagger):
    text = "Review note 4: Caps\nTo: The Desk\n\n1.2 Scope\n- old maps\n- new maps\n\n| a | b |\n| c. D | 3.5 |\r\n\r\nThe Buyer may keep the maps until the end of\nthe term; the Seller may not sell them until\nthen. It ends."
    assert parts(text, tagger) == ["Review note 4: Caps", "To: The Desk", "1.2 Scope", "- old maps", "- new maps", "| a | b |", "| c. D | 3.5 |",
                                   "The Buyer may keep the maps until the end of\nthe term; the Seller may not sell them until\nthen.", "It ends."]


def test_start_positions_and_blank_texts(spark, tagger):
    df = spark.createDataFrame([(1, "  Ab cd. Ef gh. "), (2, None), (3, ""), (4, " \n "), (5, "x" * 100_000), (1, "  Ab cd. Ef gh. ")], "doc_id bigint, text string")
    rows = sentences.units(df.distinct(), tagger).collect()
    assert sorted((r.doc_id, r.start_pos, r.unit[:4]) for r in rows) == [(1, 2, "Ab c"), (1, 9, "Ef g"), (5, 0, "xxxx")]
    assert sentences.units(df.limit(0), tagger).isEmpty()


@pytest.mark.parametrize("text", ["((((", '"""', "”“”“", ")]»", ". . . .", "…", "。。「」", "a b", "\r\r\r", "1.", "• "])
def test_odd_texts_do_not_fail(tagger, text):
    s = sentences.unit_starts(text, tagger)
    assert s == sorted(set(s)) and all(not text[k].isspace() for k in s)


def test_series_of_arrays_survives_pandas():
    assert list(pd.Series([[1], []], dtype=object)) == [[1], []]


def test_samples_never_turn_empty(spark):
    for total in (0, 1, 10**6, 10**12, 10**18, 10**30):
        bound = truncation.hash_bound(20_000, total)
        share = (bound + (1 << 63) + 1) / (1 << 64)
        assert 0 < share <= 1 and (total > 10**18 or share == pytest.approx(min(1, 20_000 / max(1, total)), rel=1e-3))
    df = spark.range(3000).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    got = truncation.sample_texts(df, "text", "key", 500)
    assert 350 < len(got) < 650 and got == truncation.sample_texts(df, "text", "key", 500)
    assert len(truncation.sample_texts(df, "text", "key", 5000)) == 3000 and truncation.sample_texts(df.limit(0), "text", "key", 5) == []
    with pytest.raises(ValueError):
        truncation.sample_texts(df.withColumn("key", F.lit("a")), "text", "key", 1)
    assert not truncation.fit_model(df.limit(0), "text", "key").is_cut("The Buyer shall pay the agreed price")


def test_copies_of_short_prompts(model):
    assert truncation.TerminalModel.fit([]).end_probability("any words") == 1.0
    for answer, prompt, want in (
        ("Intentionally omitted.", "Intentionally omitted.", True), ("Issue: Void.", "Void.", True), ("Void, and so of no effect.", "Void.", False),
        ("The clause is void.", "Void.", False), ("Void.", "", False), ("", "Void.", False), ("1 2 3", "1 2 3", False),
    ):
        assert defects.is_copy(answer, prompt) is want, answer


def test_ids_are_found_without_moving_texts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id bigint, text string")
    plan = encoding.with_ids(encoding.one_per_id(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_training_moves_what_follows_a_mark_and_what_stands_open():
    texts = [f"The fee is due{i}. It is paid.\n\nThe end (of all) is near.\n\nA {chr(97 + i % 26) * 4}{chr(97 + i // 26) * 3}. then it shut." for i in range(60)] + ["« a » b ( c"] * 40
    model = sentences.SentenceModel.fit(texts)
    assert model.moved[".", "small"] < 0 and model.stray["P"] != sentences.STRAY["P"]
    plain = sentences.SentenceModel.fit([])
    assert plain.moved == {} and plain.stray == pytest.approx(sentences.STRAY)
    found = sentences.held_out(["The fee is due.\n\nAll of it is paid.\n\nno mark", None, ""], model)
    assert found == {"latin": (1, 2)}  # before a small letter nobody expects a boundary


def test_texts_are_read_once_by_python(spark, model):
    df = spark.createDataFrame([(1, "One. Two.", "x", False)], "doc_id bigint, text string, clause_text string, at_limit boolean")
    units = sentences.with_unit_starts(encoding.one_per_id(df.select("doc_id", "text")), sentences.SentenceModel.fit([])).select("doc_id", F.explode("starts"))
    found = defects.with_defects(df.withColumnRenamed("text", "raw_response"), model).select("doc_id", F.explode("defects"))
    for q in (units, found):
        assert q._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def rare_ends(spark):
    """24,000 values; each of forty words ends three sentences, and once a value that lacks only the last period."""
    rare = ["".join(chr(97 + (k * 7 + j * (k % 11 + 3)) % 26) for j in range(5)) + "que" + chr(97 + k % 26) + chr(97 + k // 26) for k in range(40)]
    rows = [(f"r{k}-{j}", f"The Carrier shall deliver the sealed goods before the first {w}" + "." * (j < 3)) for k, w in enumerate(rare) for j in range(4)]
    rows += [(f"p{i}", f"The Buyer may keep the woven maps until the {('final', 'first', 'next')[i % 3]} delivery.") for i in range(23_840)]
    rows.append(("cut", "The Carrier shall deliver the sealed goods before the"))
    return spark.createDataFrame(rows, "response_id string, raw_response string").select("*", F.lit("q").alias("id"), F.lit("s").alias("source")).repartition(4)


def test_the_terminal_model_counts_all_rows(spark, tmp_path):
    df = rare_ends(spark)
    texts = [r.raw_response for r in df.collect()]
    whole, got = truncation.TerminalModel.fit(texts), truncation.fit_model(df, "raw_response", "response_id")
    assert got.known == whole.known and got.next == whole.next
    assert {k: [*v] for k, v in got.one.items()} == whole.one and {k: [*v] for k, v in got.two.items()} == whole.two
    spark.createDataFrame([("q", None)], "id string, clause_text string").write.parquet(f"{tmp_path}/analyze_requests.parquet")
    df.write.parquet(f"{tmp_path}/analyze_responses.parquet")
    assert [(r.response_id, r.defect) for r in queries.p4_found(spark, str(tmp_path)).collect()] == [("cut", "truncated")]


def test_counts_handed_on_early_add_up():
    texts = ["Ab cd 12. Ef gh", "ab cd 7.5 Ef.", "终止。终", None, "", "no mark here", "U.S. law…", "One. Two. ONE."] * 3
    sums = {}
    for most in (1, 4, 10**6):
        total = {}
        for *k, n, e in (r for rows in truncation.counted(texts, most) for r in rows):
            c = total.setdefault(tuple(k), [0, 0])
            c[0], c[1] = c[0] + n, c[1] + e
        sums[most] = total
    assert sums[1] == sums[4] == sums[10**6] and sum(n for n, _ in sums[1].values()) == sum(len(truncation.TerminalModel._taught(t or "")) for t in texts)


def test_cut_values_rest_on_counts_of_all_rows(spark, tmp_path):
    df = rare_ends(spark)
    df.write.parquet(f"{tmp_path}/analyze_responses.parquet")
    df.select(F.col("response_id").alias("id"), F.col("raw_response").alias("clause_text"), "source").write.parquet(f"{tmp_path}/analyze_requests.parquet")
    found = {(r.field, r.record_id) for r in queries.p5_found(spark, str(tmp_path)).collect()}
    assert found == {("clause_text", "cut"), ("raw_response", "cut")}


def test_what_repeats_is_found_without_an_estimate(spark, tmp_path, monkeypatch):
    rows = [("a", "s", "map " * 30), ("b", "s", PROSE), ("c", None, "The fee is due now. " * 4), ("d", "s", None), ("e", "s", " ")]
    spark.createDataFrame(rows, "response_id string, source string, raw_response string").write.parquet(f"{tmp_path}/analyze_responses.parquet")
    shares = {r.response_id: r for r in queries.p2_shares(spark, str(tmp_path)).collect()}
    assert {k for k, r in shares.items() if r.repetitive} == {"a", "c"} and all(r.held_against for r in shares.values())
    monkeypatch.setattr(repetition, "outliers", None)  # what decides nothing is not worked out
    found = queries.p2_found(spark, str(tmp_path))
    assert {r.response_id for r in found.collect()} == {"a", "c"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_ascii_patterns_tell_what_the_full_ones_do():
    rng = random.Random(21)
    parts = ["I cannot", " I'm unable", "Sorry", "WILL NOT", " can", "a.", "..", "...", "!", "?", "\n", "\n\n", " ", "\x1c", "\t", "don't", "x-y", "_", "9", ")", "\"", "n/a", "é", "’", "。", "Σ", "word"]
    ended = re.compile(truncation.ENDED)
    for _ in range(3_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert truncation.tokens(t) == truncation._TOKEN.findall(t)
        assert truncation.is_ended(t) == bool(ended.search(t))
        assert defects.units_of(t) == defects._UNITS.split(t) and defects.words_of(t) == defects._WORDS.findall(t)
        assert defects.declines(t) == bool(defects._REFUSAL.search(t) or defects._APOLOGY.search(t)) or not defects.cues_in(t)


def test_answers_without_a_declining_word_are_not_read_sentence_by_sentence(monkeypatch):
    monkeypatch.setattr(defects, "declines", lambda *_: pytest.fail("asked"))
    assert not defects.is_refusal("The carrier pays the fee. " * 40)
    assert not defects.is_refusal("The carrier pays the fee.")


def test_marks_asked_for_first_change_no_count(spark):
    texts = ["plain", "", "<b>x</b> & &amp; a&b;", "{a:b} {a}", "x = function (y)", "function(", "malfunction (", "a < b", "Ã¤ Â§ â€œ ï¿½ \ufffd Å", "é", "Ã", "x=function", "&#12; naïve Ã©"]
    t = F.col("t")
    counts = [quality.foreign_marks(t), F.regexp_count(t, F.lit(quality.MOJIBAKE)), quality.markup_marks(t), F.regexp_count(t, F.lit(quality.MARKUP))]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(*counts).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in rows) and sum(r[0] > 0 for r in rows) == 2 and sum(r[2] > 0 for r in rows) == 6
