"""Language, toxicity, token counts and archives."""

import base64
import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkbed.llm import buffers, langid, queries, tokencount, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, _text int"


def docs(spark, rows):
    return spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r, None)), 5) for i, r in enumerate(rows)], DOCS)


def test_word_spans_by_hand():
    import re

    rng = random.Random(1)
    texts = [None, "", "\x0b", "a"] + ["".join(rng.choice("aé \t\n\x0b\x1cb") for _ in range(rng.randrange(30))) for _ in range(200)]
    for lo, hi, data, offsets in buffers.each_slice(pa.array(texts), 64):
        starts, ends, first = buffers.word_spans(data, offsets)
        for i in range(hi - lo):
            got = [bytes(data[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
            assert got == re.findall("[^\x20\x09-\x0d]+", texts[lo + i] or "")


def test_span_hash_is_of_the_bytes_alone():
    data = np.frombuffer(b"abcabcxabd", np.uint8)
    h = buffers.span_hash(1)
    w = h.windows(h.prefix(data), 3)
    assert w[0] == w[3] != w[7]


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 40):
        code = langid.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 99
        assert len(code) == n and apart.min() >= 1
    for n in (40, 120, 300):  # a wrong bit or two of many languages is made good
        code = langid.codewords(n)
        assert ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * 99).min() >= 5


def test_language_held_out(spark, sf_dir):
    rows = queries.op10_langid(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = docs(spark, [("the cat and the dog", "en"), ("der hund und die katze", "de"), None, "", "123 !", "é", ("x", None)])
    rows = rows.withColumn("text", F.when(F.col("text") == "None", None).otherwise(F.col("text")))
    model = langid.fit(rows)
    assert model.languages == ("de", "en")
    out = {r.doc_id: r for r in langid.predict(rows, model).collect()}
    assert [out[i].lang_pred for i in (0, 1, 3, 4)] == ["en", "de", "und", "und"] and out[5].lang_pred != "und"
    assert out[4].score == 0
    none = langid.fit(rows.filter("lang = 'xx'"))
    assert {r.lang_pred for r in langid.predict(rows, none).collect()} == {"und"}
    one = langid.fit(rows.filter("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(rows, one).collect()} == {"en", "und"}
    assert langid.predict(rows.limit(0), model).count() == 0
    clash = rows.withColumns({c: F.lit(3) for c in ("lang_pred", "score", "ambiguous", "_found", "texts")})
    out = langid.predict(clash.unionByName(clash), model, ("doc_id", "_text")).collect()
    assert len(out) == 14 and len({(r.doc_id, r.lang_pred, r.score, r._text) for r in out}) == 7
    left = rows.filter(langid.language_of(rows, model) != "und")
    assert left.columns == rows.columns and sorted(r.doc_id for r in left.collect()) == [0, 1, 5, 6]
    same = langid.fit(docs(spark, [("one text", "en"), ("one text", "de")]))
    tie = langid.predict(docs(spark, ["one text", "the cat " * 200_000]), same).collect()
    assert tie[0].lang_pred == "de" and tie[0].ambiguous and len(tie) == 2


SYLLABLES = ["an", "the", "or", "ing", "re", "th", "er", "on"]


@pytest.fixture(scope="module")
def insults():
    """A machine trained on invented prose in which toxic documents hold one of three plain insults."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))
    texts, labels = [], []
    for i in range(400):
        t = [word() for _ in range(rng.randrange(5, 60))]
        if i % 4 == 0:
            t.insert(rng.randrange(len(t)), rng.choice(["dumbo", "scumbag", "moronic"]))
        texts.append(" ".join(t))
        labels.append(int(i % 4 == 0))
    return toxicity.train(texts, np.array(labels))


def scores(model, texts):
    return np.concatenate([model.score(toxicity.text_decisions(d, o, model)) for _, _, d, o in buffers.each_slice(pa.array(texts, pa.string()))])


FILLERS = [".", "-", "*", "_", "x", "é", " ", "..", "xx", "\u200b", "\u00b7", "7", ""]


@pytest.mark.parametrize("context", ["{}", "an the {} or re"])
def test_toxicity_finds_gapped_insults(insults, context):
    forms = [f.join(w) for w in ("dumbo", "scumbag", "moronic") for f in FILLERS]
    forms += ["scum.bag", "mor-onic", "du mbo", "scum bag", "dumbos", "DUMBO", "dúmbo"]
    found = scores(insults, [context.format(x) for x in forms])
    assert [x for x, s in zip(forms, found, strict=True) if s < 0.5] == []


@pytest.mark.parametrize("context", ["{}", "an the {} or re"])
def test_toxicity_leaves_gapped_clean_words(insults, context):
    forms = [f.join(w) for w in ("anthe", "theorer", "reingth", "thingore", "oneranon") for f in FILLERS] + ["an the or ing", "theorer anthere"]
    found = scores(insults, [context.format(x) for x in forms])
    assert [x for x, s in zip(forms, found, strict=True) if s >= 0.5] == []


def filled(word, many, rng):
    """The word with ``many`` random letters between any two of its letters."""
    return "".join(c + "".join(chr(rng.randrange(97, 123)) for _ in range(many)) for c in word[:-1]) + word[-1]


@pytest.mark.parametrize("many", [1, 2, 3])
@pytest.mark.parametrize("context", ["{}", "an the {} or re"])
def test_toxicity_reads_over_different_letters(insults, context, many):
    rng = random.Random(9)
    bad = [context.format(filled(w, many, rng)) for w in ("dumbo", "scumbag", "moronic") for _ in range(20)]
    assert (scores(insults, bad) >= 0.5).mean() >= 0.9
    assert (scores(insults, [context.format("xxx".join(w)) for w in ("dumbo", "scumbag", "moronic")]) >= 0.5).all()
    clean = [context.format(filled(w, many, rng)) for w in ("anthe", "theorer", "reingth", "thingore", "oneranon") for _ in range(12)]
    assert (scores(insults, clean) >= 0.5).mean() <= 0.02


ENGLISH = """The music and harmony of summer filled the garden. | We walked along the river and talked about the weather. | Music and harmony and summer
The committee approved the budget for next year. | She bought three loaves of bread and some cheese. | The spectrum of light was measured in the laboratory.
He scored twice in the second half of the match. | Please read the manual before you install the program. | The train to London leaves at half past seven.
Children played football in the park until sunset. | Our results show a significant improvement over the baseline. | The stomach and the muscles of the abdomen
The recipe needs two eggs, flour, sugar and a little milk. | Paintings by local artists hang in the museum lobby. | Documentation of the numerous boxes
A customer ordered a lamp and a wooden table. | Heavy rain is expected in the north on Friday. | The teacher explained how volcanoes form."""


def test_toxicity_leaves_ordinary_english(spark):
    sf = "/root/testdata/sf0.01"
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").filter("crc32(CAST(doc_id AS STRING)) % 5 != 0"))
    lines = [x.strip() for line in ENGLISH.splitlines() for x in line.split("|")]
    assert [x for x, s in zip(lines, scores(model, lines), strict=True) if s >= 0.5] == []


def test_toxicity_of_odd_texts(insults):
    clean = " ".join(SYLLABLES) + " "
    long_ = clean * (3 * toxicity.PIECE // len(clean))
    found = scores(insults, ["", None, "7 !", "\u65e5\u672c \U0001f642", long_, long_ + "dumbo", "dumbo " + long_])
    assert (found >= 0.5).tolist() == [False, False, False, False, False, True, True]
    for i in (200, 2 * toxicity.PIECE + 3):  # wherever a very long text is cut
        assert scores(insults, [long_[:i] + " scumbag " + long_[i:]])[0] >= 0.5
    assert len(scores(insults, ["dumbo"] * 3)) == 3


def test_toxicity_of_neighbours(insults):
    """A score is that of the text alone."""
    texts = ["an the", "dumbo", "", "or scumbag", None, "re", "moronic", "th"]
    assert scores(insults, texts).tolist() == [float(scores(insults, [t])[0]) for t in texts]


def test_toxicity_learns_from_texts_of_any_size():
    short = ["", "a", "dumbo", "the or", "the dumbo an", "7", "one two thr", "one two thre", "you dumbo", "an the or ing re th er on"] * 4
    model = toxicity.train(short, np.array([int("dumbo" in t) for t in short]))
    assert (scores(model, ["dumbo", "an the", "", "x dumbo y"]) >= 0.5).tolist() == [True, False, False, True]


def test_toxicity_held_out(spark):
    """Folds that are not learned from, on the tables."""
    sf = "/root/testdata/sf0.01"
    rows = queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out AND toxic IS NOT NULL").collect()
    assert np.mean([r.predicted for r in rows if r.toxic]) >= 0.5 and np.mean([r.predicted for r in rows if not r.toxic]) <= 0.1


def test_toxicity_query_and_edges(spark, sf_dir):
    out = queries.op3_toxicity(spark, sf_dir)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.filter("score < 0 OR score > 1 OR predicted != CAST(score >= 0.5 AS INT)").count() == 0
    rows = docs(spark, ["a b", None, ""])
    labels = spark.createDataFrame([(0, None), (1, 1), (None, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(rows, labels)
    assert model is toxicity.EMPTY and {r.predicted for r in toxicity.predict(rows, model).collect()} == {0}
    assert toxicity.predict(rows.limit(0), model).count() == 0
    clash = rows.withColumns({c: F.lit("z") for c in ("score", "predicted", "toxic", "symbols")})
    twice = clash.unionByName(clash)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (0, 1)], "doc_id bigint, toxic int")
    assert toxicity.predict(twice, toxicity.fit(twice, labels)).count() == 6


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_tokens_equal_the_library(spark, tokenizer):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = [None, "", " ", "\n\n a", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endof", "I'll 12 'S x" * 50, "日本語 🙂 é x　y", "a" * 5000]
    texts += ["".join(rng.choice(["the", " ", "  ", "\n", "\t", "é", "'s", "1", "!!", "ß", "​", "<|endoftext|>"]) for _ in range(60)) for _ in range(100)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    library = Tokenizer.from_file(tokenizer)
    for r in tokencount.count_tokens(rows, tokenizer).collect():
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False))), t
    assert tokencount.count_tokens(rows.limit(0), tokenizer).count() == 0
    odd = spark.createDataFrame([(None, "a b", "x"), (1, "a b", "x"), (1, "a b", "x"), (2, "ab " * 300_000, "y"), (3, "z" * 60_000, "y")], "doc_id bigint, text string, _text string")
    out = sorted((r.doc_id or 0, r.n_tokens) for r in tokencount.count_tokens(odd, tokenizer).collect())
    size = lambda t: len(library.encode(t, add_special_tokens=False))
    assert out == [(0, 2), (1, 2), (1, 2), (2, size("ab " * 300_000)), (3, size("z" * 60_000))]


def test_tokens_on_the_table(spark, sf_dir, tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op9_tokencount(spark, sf_dir).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False)) and r.n_bytes == len(texts[r.doc_id].encode())


def test_other_tokenizers_are_refused(tmp_path, tokenizer):
    import json

    told = json.load(open(tokenizer))
    told["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(told))
    with pytest.raises(ValueError, match="pre-tokenizer"):
        tokencount._loaded(str(tmp_path / "t.json"))


def test_cache_is_bounded(tokenizer):
    lengths = tokencount.Lengths(tokencount._loaded(tokenizer)[0].encode, {}, most=3)
    assert lengths["x" * 1000] and not lengths.seen
    assert [lengths[f"w{i}"] for i in range(10)] and len(lengths.seen) <= 3


def test_archive_round_trip(spark):
    html = [None, "", "<p>a</p>", "<p>a</p>", "x" * 100_000, "é\r\n\r\nWARC/1.1\r\n", "<p>a</p>", ""]
    pages = spark.createDataFrame([(10 - i, f"http://e.org/{i} ?" if i else None, h, "x") for i, h in enumerate(html)], "page_id bigint, url string, html string, digest string")
    got = {r.page_id: r for r in warc.read(warc.write(pages)).collect()}
    first = {}
    for i, h in enumerate(html):
        first[h or ""] = 10 - i  # the last has the smallest id
    for i, h in enumerate(html):
        r, raw = got[10 - i], (h or "").encode()
        revisit = first[h or ""] != 10 - i
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("revisit", first[h or ""]) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == raw
    least = warc.read(warc.write(pages, least=5)).filter("payload_bytes = 0").collect()
    assert {r.record_type for r in least} == {"response"}
    assert warc.write(pages.limit(0)).count() == 0


def test_many_archives_are_read_by_many_tasks(spark):
    rng = random.Random(9)
    rows = [(i, f"u{i}", "".join(rng.choice("abcdefgh") for _ in range(3000)), i) for i in range(200)] + [(500, "v", "x" * 3_000_000, 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int").withColumns({c: F.lit(0) for c in ("path", "records", "first", "size", "payload")})
    archives = warc.write(pages, archive_bytes=20_000)
    assert archives.count() >= 8 and archives.agg(F.sum("records")).first()[0] == 201
    got = warc.read(archives).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows) and len({r.task for r in got}) >= 4
    assert {r.page_id: r.payload_bytes for r in got}[500] == 3_000_000


def test_archives_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    first = {}
    for r in sorted(pages, key=lambda r: r.page_id):
        first.setdefault(r.html or "", r.page_id)
    for r in queries.op5_warc(spark, sf_dir).collect():
        html = next(p.html or "" for p in pages if p.page_id == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[html] == r.page_id else ("revisit", first[html]))


def test_repeated_rows_are_both_responses(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a")], "page_id bigint, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.read(warc.write(pages)).collect())
    assert got == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_foreign_and_zip64_archives():
    out = io.BytesIO()
    n = warc.write_archive(out, iter([(1, "u", b"one", warc.payload_digest(b"one"), 1, False), (2, "u", b"one", warc.payload_digest(b"one"), 1, True)]))
    raw = out.getvalue()
    assert n == 2 and [r["record_type"] for r in warc.Archive(_File(raw)).records()] == ["response", "revisit"]
    assert zipfile.ZipFile(io.BytesIO(raw)).testzip() is None
    assert zlib.decompress(zipfile.ZipFile(io.BytesIO(raw)).read(warc.DATA), 31).startswith(b"WARC/1.1")
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:  # more members than the short directory can count
        for i in range(65_600):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
        with z.open(zipfile.ZipInfo("last"), "w", force_zip64=True) as f:
            f.write(b"abc")
    found = warc.Archive(_File(many.getvalue()))
    at, size = found.start("last")
    assert len(found.members) == 65_601 and found.read(at, size) == b"abc"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m", b"a" * 100)
    with pytest.raises(ValueError, match="compressed"):
        warc.Archive(_File(packed.getvalue())).start("m")
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.Archive(_File(b"nothing"))
