"""Tokens, containers, reading levels, personal data."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tendril.llm import packing, pii, pii_corpus, pii_model, pii_train, reading, tokens

ODD = [None, "", " ", "  ", "a  b", " a", "a ", "\n\n x", "a​ b", "Łódź 12,50 zł 's don't", "<|endoftext|>", "😀 é", "x" * 30_000, " " * 20_000 + "y", "word " * 20_000, "a\n" + " " * 5000 + "b", "a \xa0 \xa0", "\n \xa0 \xa0", "\t \xa0 \xa0"]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.rank_file())


def test_ids_equal_the_library_s(encoder):
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\xa0", "\u2003", "\x0b", "\x1c", "\x85", "a", "Bc", "'s", "12", "ł", ".", "—", "😀", " "]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(20000)]
    got = encoder.batch(pa.array(texts)).to_pylist()
    assert got == [encoder.bpe.encode_ordinary(t or "") for t in texts]
    assert encoder.batch(pa.array(texts), count=True).to_pylist() == [len(x) for x in got]
    for t, ids in zip(texts, got, strict=True):
        assert encoder.decode(ids) == (t or "")


def test_ids_equal_the_other_library_s(encoder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = [x for x in ODD if x]
    assert encoder.batch(pa.array(texts)).to_pylist() == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_very_long_blank_runs(encoder):
    text = "a" + " " * 1_500_000 + "b"
    assert encoder.decode(encoder.text(text)) == text


def test_columns(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    rows = df.select("doc_id", "text", tokens.ids(spark, F.col("text")).alias("k"), tokens.count(spark, F.col("text")).alias("n"), "ids").withColumn("back", tokens.text_of(spark, F.col("k"))).collect()
    assert all(r.n == len(r.k) and r.back == (r.text or "") for r in rows) and len(rows) == len(ODD)
    assert spark.createDataFrame([], df.schema).select(tokens.ids(spark, F.col("text"))).count() == 0


def test_plan_fills_containers():
    r = random.Random(3)
    for sizes, least in (([r.randint(1, 900) for _ in range(3000)], 0.99), ([r.randint(1, 2048) for _ in range(400)], 0.9), ([700] * 100, 0), ([2048] * 5 + [1], 0), ([3] * 5000, 0.91), ([], 0)):
        patterns = packing.plan(Counter(sizes), 2048)
        used = Counter()
        for lengths, n in patterns:
            assert n > 0 and sum(lengths) <= 2048
            for s in lengths:
                used[s] += n
        assert used == Counter(sizes)
        boxes = sum(n for _, n in patterns)
        assert not boxes or sum(sizes) / (2048 * boxes) >= least
    with pytest.raises(ValueError):
        packing.plan({2049: 1}, 2048)


def test_fill(spark):
    r = random.Random(4)
    sizes = [0, 0, None, 5000, 4096, 2048, *[r.randint(1, 1200) for _ in range(600)], *[7] * 500]
    df = spark.createDataFrame([(i, n, "c", 1) for i, n in enumerate(sizes)] + [(6, sizes[6], "c", 1)], "n long, len int, container string, place int")
    rows = packing.fill(df, "n", F.col("len"), 2048).collect()
    boxes, parts = defaultdict(list), defaultdict(list)
    for row in rows:
        if row.container is None:
            assert (row.start_token, row.end_token, row.place) == (0, 0, None)
        else:
            boxes[row.container].append(row)
        parts[row.n].append((row.start_token, row.end_token))
    assert all(sum(x.end_token - x.start_token for x in b) <= 2048 and sorted(x.place for x in b) == list(range(len(b))) for b in boxes.values())
    assert sorted(boxes) == list(range(len(boxes)))
    for i, n in enumerate(sizes):
        p = sorted(parts[i])
        want = [(s, min(s + 2048, n)) for s in range(0, n or 0, 2048)] or [(0, 0)]
        assert p == (sorted(want * 2) if i == 6 else want)
    assert sum(n or 0 for n in sizes) / (2048 * len(boxes)) > 0.97
    assert packing.fill(spark.createDataFrame([], df.schema), "n", F.col("len"), 2048).count() == 0


def samples():
    out = []
    for lang in ("en", "de"):
        for level in (1, 2, 3, 4):
            words = [f"{lang}{'abcd'[level - 1]}{c}{d}" for c in "klmno" for d in "rst"]
            for k in range(8):
                r = random.Random(f"{lang}{level}{k}")
                out.append((lang, level, " ".join(r.choice(words) for _ in range(150))))
    return out


def test_isotonic():
    bounds, values = reading.isotonic(np.array([1, 2, 3, 4, 5.0]), np.array([1, 3, 2, 4, 4.0]))
    assert values == sorted(values) and values[0] == 1 and values[-1] == 4 and 2.5 in values


def test_words():
    assert reading.word_of("<p>Größe</p>,")[0] == "grosse" == reading.word_of("GrÃ¶Ã\x9fe")[0]
    assert reading.word_of("35022200;167;DOLON;19754.25;EUR") == ("#", False) and reading.word_of("​") == ("", False)
    assert reading.word_of("l'atelier") == ("l'atelier", True)


def test_levels(spark):
    known = samples()
    text = {(lang, level): t for lang, level, t in known}
    mixed = " ".join([text["en", 2]] * 3 + [text["en", 4]] * 0 + [" ".join(text["en", 3].split()[:60])])
    rows = [(1, text["en", 1]), (2, text["de", 4]), (3, text["de", 3].upper()), (4, mixed), (5, None), (6, ""), (7, " "), (8, "enakr enakr"), (9, "35022200;167;DOLON;1.5;EUR\n" * 90), (10, text["en", 2] * 60), (11, text["en", 4].replace(" ", "​  \n"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, level string")
    s = spark.createDataFrame([*known, ("en", None, "x"), (None, 1, "x"), ("de", 2, None)], "lang string, level int, text string")
    got = {r.doc_id: r.r.level for r in df.select("doc_id", reading.level(spark, F.col("text"), s).alias("r")).collect()}
    assert got == {1: 1, 2: 4, 3: 3, 4: 2, 5: None, 6: None, 7: None, 8: None, 9: None, 10: 2, 11: 4}
    with pytest.raises(ValueError):
        reading.fit([])


def test_level_reads_a_text_once(spark):
    """A filter on the result must not run the models again."""
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    s = spark.createDataFrame([(lang, level, t) for lang, level, t in samples()], "lang string, level int, text string")
    read = df.select("doc_id", reading.level(spark, F.col("text"), s).alias("r")).where("r.level is not null").select("doc_id", F.col("r.level").alias("level"))
    assert read._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_held_out_levels():
    known = samples()
    model = reading.fit([x for i, x in enumerate(known) if i % 8 < 6])
    held = [x for i, x in enumerate(known) if i % 8 >= 6]
    scorer = reading.Scorer(model)
    d, _, about = scorer.batch(pa.array([t for *_, t in held]))
    assert (about > 0).all()
    assert scorer.level(d).tolist() == [level for _, level, _ in held]


def test_gradients():
    p = {k: v for k, v in pii_model.init(6).items()}
    maker = pii_corpus.Maker(2)
    ids, mask, tags = pii_train.batch_of([maker.write() for _ in range(12)])
    ids, mask, tags = ids[:20, :3], mask[:20, :3], np.where(mask, tags, 0)[:20, :3]
    _, g = pii_model.loss_and_grads(p, ids, mask, tags)
    for name, at in (("hf", (1, 3)), ("hb", (2, 15)), ("o", (3, 0)), ("t", (0, 1)), ("ob", (0,)), ("xb", (int(ids[4, 0]), 7))):
        e = 0.02
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += e
        down[name][at] -= e
        slope = (pii_model.loss_and_grads(up, ids, mask, tags)[0] - pii_model.loss_and_grads(down, ids, mask, tags)[0]) / (2 * e)
        assert abs(slope - g[name][at]) < 0.02 * abs(slope) + 1e-4


def test_held_out_spans():
    """Texts of a seed that training has not seen."""
    scores = pii_train.score(pii.weights(), seed=4711, n=500)
    assert scores["ALL"] > 0.97 and min(scores.values()) > 0.9


def test_windows_are_joined():
    """A text of many windows has the spans of its parts."""
    p = pii.weights()
    part = "Zakup: namioty modułowe Abakus-12. Osoba do kontaktu: Zofia Rakemewska, tel. +48626102795. "
    one = pii.checked(part, pii_model.tag(p, [part])[0])
    assert [k for *_, k in one] == ["PERSON_NAME", "PHONE"]
    many = pii.checked(part * 40, pii_model.tag(p, [part * 40])[0])
    assert many == [(a + i * len(part), b + i * len(part), k) for i in range(40) for a, b, k in one]


def test_find_and_mask(spark):
    rows = [(1, "kontakt: zofia.ra@poczta.example"), (2, None), (3, ""), (4, " \n"), (4, "tel. 762-370-809"), (5, "nr magazynowy 600 355 600"), (None, "PESEL 89251933789")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, kind string")
    got = sorted((r.id or 0, r.kind, r.start_at, r.end_at) for r in pii.find(df, "id", "text").collect())
    assert got == [(0, "ID_NUMBER", 6, 17), (1, "EMAIL", 9, 32), (4, "PHONE", 5, 16)]
    masked = {r.id: r.m for r in df.where("id <> 4").select("id", pii.mask(df, F.col("text")).alias("m")).collect()}
    assert masked == {1: "kontakt: [EMAIL]", 2: None, 3: "", 5: "nr magazynowy 600 355 600"}
    assert pii.find(spark.createDataFrame([], df.schema), "id", "text").count() == 0


def test_ordinary_sentences():
    """Sentences of another style than the training texts; F1 of whole spans is 0.92, and what is found is right."""
    from tests.llm.ordinary import cases

    rows = cases()
    found = [set(pii.checked(t, s)) for (t, _), s in zip(rows, pii_model.tag(pii.weights(), [t for t, _ in rows]), strict=True)]
    want = sum(len(s) for _, s in rows)
    right = sum(len(s & g) for (_, s), g in zip(rows, found, strict=True))
    assert 2 * right / (want + sum(map(len, found))) >= 0.9
    names = sum(1 for _, s in rows for x in s if x[2] == "PERSON_NAME")
    assert sum(1 for (_, s), g in zip(rows, found, strict=True) for x in s & g if x[2] == "PERSON_NAME") >= 0.75 * names


def test_training_is_a_function_of_steps_and_seed():
    a, b = pii_train.train(2, 5, 2), pii_train.train(2, 5, 2)
    assert all((a[k] == b[k]).all() for k in a)
