from pyspark.sql import functions as F
from tributary.llm import lang_id as L

from .cases import table


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = L.op9_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.avg(F.col("rejected").cast("int")).alias("r"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a > 0.97 and r.r < 0.03 and r.lo >= 0 and r.hi <= 1
    assert got.where((F.crc32(F.col("doc_id").cast("string")) % 5 == 0) != F.col("held_out")).count() == 0


def test_rows(spark):
    docs = table(spark)
    known = L.learn(docs)
    assert list(known) == ["en"]
    got = L.predict(docs, known).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        blank = texts[r.doc_id] is None or not any(c.isalpha() for c in texts[r.doc_id])
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == blank == r.rejected
    kept = L.determined(docs.withColumn("rejected", F.lit(1)).withColumn("lang_pred", F.lit("x")), known)
    assert kept.columns == [*docs.columns, "rejected", "lang_pred"] and 4 not in {r.doc_id for r in kept.collect()}
    assert L.predict(table(spark, []), known).count() == 0


def test_letters_of_unicode_alone_count():
    judge = L.Judge({"a": b"alpha beta gamma delta " * 50, "b": b"uno dos tres cuatro cinco " * 50})
    for text in ("\u00bd \u00b2 7", "\u2460 \u2461", "\u2167 \u2168", "_ 12 \u0301", "\U0001f600 \u4dc0", ""):
        assert judge(text) == ("und", 0.0), text
    for text in ("\u00aa", "\u4e2d", "\u02b0", "x\u00b2"):
        assert judge(text)[0] != "und", text


def brute_sample(rows, documents):
    """(doc_id, cut) of each language, by the definition."""
    import regex

    out = {}
    for h, doc, text, lang in sorted({r for r in rows if r[1] is not None and r[3] is not None and r[2] and regex.search(r"\p{L}", r[2])}, key=lambda r: (r[0], r[1])):
        out.setdefault(lang, []).append((doc, text))
    return {lang: sorted(x[:documents]) for lang, x in out.items()}


def test_the_sample_is_that_of_least_hashes(spark):
    """However few of a label's rows have letters, its sample is the one that the definition names."""
    texts = [(i, f"text number {'abcdefghij'[i % 10]}{i}" if i % 3 or i < 40 else "12 34", "xy"[i % 2] if i % 11 else None) for i in range(3000)]
    texts += [(5000 + i, "77" if i % 40 else f"rare letters {i}", "z") for i in range(2000)] + [(9000, None, "none"), (9001, "123", "none"), (None, "abc", "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    rows = [(r.h, r.doc_id, r.text, r.lang) for r in docs.withColumn("h", F.xxhash64("doc_id")).collect()]
    for documents in (3, 30):
        want = brute_sample(rows, documents)
        got = L.learn(docs, documents=documents)
        assert set(got) == {"x", "y", "z"} == set(want)
        assert got == {lang: "\n".join(t for _, t in x).encode() for lang, x in want.items()}
    assert list(got) == ["z", "x", "y"] or list(got) == ["z", "y", "x"]


def test_prediction_is_the_smallest_of_the_compressed_sizes(spark):
    """Against zstandard used plainly, one compressor a text and dictionary."""
    import zstandard

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    known = L.learn(docs.where(~L.held_out(F.col("doc_id"))))

    def size(data, content, kind):
        p = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **kind)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
        return sum(len(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress(data[i : i + L.BLOCK])) for i in range(0, len(data), L.BLOCK))

    got = {r.doc_id: r for r in L.predict(docs, known).collect()}
    for r in docs.limit(60).collect():
        if not any(c.isalpha() for c in r.text or ""):
            continue
        data = r.text.lower().encode()
        sizes = {k: size(data, c, L.FAST) for k, c in known.items()}
        least = min(sizes.values())
        if sorted(sizes.values())[1] > least:
            assert sizes[got[r.doc_id].lang_pred] == least
            second, plain = sorted(sizes.values())[1], size(data, b"", L.FAST)
            assert abs(got[r.doc_id].score - (second - least) / (max(plain, second) - least)) < 1e-12


def test_nothing_learned(spark):
    assert L.learn(table(spark, [])) == {}
    assert {r.lang_pred for r in L.predict(table(spark), {}).collect()} == {"und"}


def test_long_texts_are_judged_whole():
    judge = L.Judge({"a": b"alpha beta gamma delta " * 50, "b": b"uno dos tres cuatro cinco " * 50})
    assert judge("alpha beta " * 3 + "uno dos tres cuatro cinco " * 20_000)[0] == "b"
    assert judge("ALPHA BETA GAMMA")[0] == "a" and judge("12345 !?") == ("und", 0.0) and judge(None) == ("und", 0.0)
