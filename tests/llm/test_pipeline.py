import random

import pytest

import corpus_pipeline
from tarnflow.llm import language_id as li
from tarnflow.llm import line_dedup as ld
from tarnflow.llm import quality_rules as qr
from tests.llm.test_jaccard_join import brute as brute_components
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_packing import check_rows

STEMS = {"en": "the of and that with ing ed sh th ou".split(), "fr": "le de et que dans eau oi é è ç".split()}


def corpus():
    rng = random.Random(8)
    word = lambda lang: "".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 4)))
    prose = lambda lang, n: "\n".join(" ".join(word(lang) for _ in range(rng.randint(4, 14))) + "." for _ in range(n))
    rows = []
    for k in range(160):
        lang = rng.choice(["en", "fr"])
        rows.append((k, prose(lang, rng.randint(2, 14)), lang, "web", 5))
    passage = prose("en", 12)
    rows += [(200 + k, f"{prose('en', 4)}\n{passage}\n{prose('en', 4)}", "en", "web", 5) for k in range(6)]
    rows += [(300 + k, rows[k][1], rows[k][2], None, None) for k in range(8)]
    for k in range(8):
        words = rows[20 + k][1].split(" ")
        words[len(words) // 2] = "other"
        rows.append((400 + k, " ".join(words), rows[20 + k][2], "web", 5))
    rows += [(500, None, "en", "web", 0), (501, "", None, "web", 0), (502, "12 34 !! ##", "en", "web", 0), (503, "spam " * 400, "en", "web", 0), (504, "too short text", "en", "web", 0)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert set(before) - set(after) == {500, 501, 502}
        elif name == "quality_rules":
            rules = qr.Rules(qr.Bands())
            assert set(after) == {k for k, text in before.items() if rules.measure(text)[6]}
            assert not {503, 504} & set(after)
            assert len(after) > 160
        elif name == "line_dedup":
            expected = dict(brute_lines(spark, list(before.items())))
            assert after == {k: t for k, t in expected.items() if t.split()}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
            assert not {300, 301, 302} & set(after)
        else:
            label = {a: c for a, _, c in brute_components(list(before.items()))}
            assert set(after) == {a for a, c in label.items() if a == c}
        before = after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    check_rows(rows, before, 1024)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.ids_crc32 for r in whole) == sorted(r.ids_crc32 for r in rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    """Null and repeated ids, a very long text, and extra columns with clashing names."""
    rng = random.Random(21)
    rows = [(*r, 1, "x", 2.0, True) for r in corpus()[:60]]
    text = lambda n: "\n".join(" ".join(rng.choice(STEMS["en"]) + rng.choice(STEMS["en"]) + str(rng.randrange(10**6)) for _ in range(8)) for _ in range(n))
    long_text, alone, twice = text(30_000), text(6), text(7)
    rows += [(700, long_text, "en", "web", 1, 1, "y", 1.0, None), (None, alone, "en", "web", 1, 1, "y", 1.0, None), (None, None, None, None, None, None, None, None, None)]
    rows += [(701, twice, "en", "web", 1, 1, "y", 1.0, None)] * 3 + [(5, text(5), "en", "web", 1, 2, "z", 0.5, False), (None, rows[7][1], "en", "web", 1, 1, "y", 1.0, None)]
    frame = spark.createDataFrame(rows, SCHEMA + ", component_id int, h1 string, score double, held_out boolean").repartition(5)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == frame.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    left = docs.select("doc_id", "text").collect()
    ids = [r.doc_id for r in left if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and {700, 701, 5} <= set(ids)
    assert {r.text for r in left if r.doc_id in (None, 700, 701)} == {alone, long_text, twice}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len(set(ids)) + 1
    assert packed.filter("doc_id = 700").count() > 100


def test_language_rows(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", score int")
    got = {r.doc_id: r for r in li.identify(frame).collect()}
    assert len(got) == len(rows)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (500, 501, 502))
    right = [got[k].lang_pred == lang for k, text, lang, *_ in rows if k < 500 and got[k].held_out]
    assert len(right) > 20 and sum(right) >= 0.95 * len(right)
    # without labels every text is unknown; ties go to the first name
    assert {r.lang_pred for r in li.identify(frame.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_naive_bayes_against_plain_sums():
    """Sparse scoring equals adding one log-probability after the other."""
    import numpy as np

    s = li.Settings(buckets=64, evidence=1e9)
    rng = np.random.default_rng(1)
    model = li.Model(["a", "b", "c"], rng.normal(-4, 1, (64, 3)), np.log([0.5, 0.3, 0.2]), s)
    texts = ["some words", "x", "Ünï cödé", "aaa aaa"]
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores):
        bucket, _ = li.buckets_of([text], s)
        assert len(bucket) == sum(len(text) + 2 - k for k in range(3))
        total = model.prior.copy()
        for b in bucket:
            total += model.weights[b]
        chance = np.exp(total - total.max())
        assert name == model.names[chance.argmax()]
        assert score == pytest.approx((chance / chance.sum()).max())


def test_a_single_line_is_no_passage():
    s = ld.Settings()
    assert not list(ld.passages("one line", s)) and not list(ld.passages("one\n \n", s)) and len(list(ld.passages("a\nb", s))) == 1


def test_long_texts_outweigh_the_prior():
    """The decision is that of the full sum plus prior, however small the share of a language."""
    import numpy as np

    s = li.Settings(buckets=64)
    weights = np.full((64, 2), -4.0)
    weights[:, 1] += 0.05
    model = li.Model(["common", "rare"], weights, np.log([0.999, 0.001]), s)
    text = "clean words of a rare language " * 40
    (name,), (score,) = model.predict([text])
    assert name == "rare" and 0.5 < score < 1
    assert model.predict(["short"])[0] == ["common"]


def test_every_language_is_learnt(spark):
    """More languages than a matrix holds give the same as one matrix for all."""
    rng = random.Random(9)
    rows = [(k, " ".join(chr(0x430 + 5 * (k % 5) + rng.randrange(5)) * 2 for _ in range(30)), f"l{k % 5}") for k in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    key = lambda r: r.doc_id
    split, whole = (sorted(li.identify(frame, li.Settings(languages=n)).collect(), key=key) for n in (2, 200))
    assert split == whole
    assert [r.lang_pred for r in split] == [lang for _, _, lang in rows]
    assert li.keep_identified(frame, settings=li.Settings(languages=2)).count() == len(rows)
