"""Language ID by compression: the language whose text, as a zstandard dictionary, helps most.

Each language's raw-content dictionary is cut from a bounded sample of labelled documents. A text is
compressed once with each; the smallest result names its language, and how far it is ahead of the
next, against what the dictionary saved at all, is the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .io import table
from .words import relax

#: Labelled documents per language that dictionaries are cut from, characters taken of each (from
#: its middle), and bytes of a dictionary.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, DICTIONARY_BYTES = 96, 1200, 48 << 10
#: Matches of four bytes or more against a block; ties are compressed again with matches of three.
FAST = dict(window_log=17, chain_log=16, hash_log=16, search_log=3, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY)
FINE = dict(window_log=17, chain_log=16, hash_log=16, search_log=5, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTULTRA)
#: Bytes that are compressed at once, so that the dictionary stays in reach: a longer text is the sum of its blocks.
BLOCK = 32 << 10
#: A text whose score is below this is rejected, as is one without a letter.
MIN_MARGIN = 0.02
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def learn(docs: DataFrame, label: str = "lang", documents: int = SAMPLE_DOCUMENTS) -> dict[str, bytes]:
    """A dictionary for each non-null ``label``, from the ``documents`` rows of each whose hashed
    doc_id is least; the most frequent label comes first. Rows without text or letters teach
    nothing; no rows, no languages.

    Labels are counted first, without the texts; these tell below which hash some four times as many
    rows lie, so that few of the texts go further than their scan. A label that yields too few, for
    want of letters, is asked again with more."""
    held = {r.lang: r["count"] for r in docs.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("lang")).count().collect()}
    share, cuts = {lang: 4 * documents / n for lang, n in held.items()}, {}
    h, order = F.xxhash64("doc_id"), W.partitionBy("lang").orderBy("h", "doc_id", "cut")
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - SAMPLE_CHARS) / 2).cast("int"))
    asked = list(held)
    while asked:
        bounds = F.create_map(*[F.lit(x) for lang in asked for x in (lang, min((1 << 63) - 1, int(min(1.0, share[lang]) * (1 << 64)) - (1 << 63)))])
        rows = docs.select("doc_id", "text", F.col(label).alias("lang"), h.alias("h")).where(F.col("doc_id").isNotNull() & F.col("lang").isin(asked) & (F.col("h") <= bounds[F.col("lang")]) & F.col("text").rlike("\\p{L}"))
        cut = rows.select("lang", "h", "doc_id", F.substring("text", middle, F.lit(SAMPLE_CHARS)).alias("cut")).distinct()
        found: dict[str, list] = {}
        for r in cut.withColumn("k", F.row_number().over(order)).where(F.col("k") <= documents).collect():  # at most documents x languages
            found.setdefault(r.lang, []).append((r.doc_id, r.cut))
        cuts |= {lang: [c for _, c in sorted(x)] for lang, x in found.items()}
        asked = [lang for lang in asked if len(found.get(lang, ())) < documents and share[lang] < 1]
        share = {lang: 32 * f for lang, f in share.items()}
    return {lang: "\n".join(cuts[lang]).lower().encode()[-DICTIONARY_BYTES:] for lang in sorted(cuts, key=lambda x: (-held[x], x))}


class Judge:
    """Compressors of one process, one per language and one without a dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = list(dictionaries)
        self.fast, self.fine = ([self._compressor(d, kind) for d in (*dictionaries.values(), b"")] for kind in (FAST, FINE))

    @staticmethod
    def _compressor(content: bytes, kind: dict):
        p = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **kind)
        if not content:
            return zstandard.ZstdCompressor(compression_params=p).compress
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Language and score; ``und`` and 0 for null, no letter, or nothing learned."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        data = text.lower().encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        for compressors in (self.fast, self.fine):
            *sizes, plain = [sum(len(c(b)) for b in blocks) for c in compressors]
            if len(sizes) == 1:
                return self.langs[0], 1.0
            best, second = sorted(sizes)[:2]
            if second > best:
                break
        saved = max(plain, second) - best
        return self.langs[sizes.index(best)], (second - best) / saved if saved > 0 else 0.0


def judged(text: Column, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> Column:
    """A struct of lang_pred, score and rejected for each text, compressed whole."""
    shipped = SparkSession.active().sparkContext.broadcast(dictionaries)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by_text = Judge(shipped.value)
        for texts in batches:
            found = [by_text(t) for t in texts]
            yield pd.DataFrame({"lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "rejected": [f[0] == UNDETERMINED or f[1] < min_margin for f in found]})
            relax()

    return judge(text)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row.

    ``lang_pred`` is ``und`` where text is null or has no letter; ``rejected`` holds there and where
    the score is below ``min_margin``. Equal sizes go to the language with most labels, with score 0.
    Needs no shuffle; rows stay rows; other columns aren't read.
    """
    return docs.select("doc_id", judged(F.col("text"), dictionaries, min_margin).alias("j")).select("doc_id", "j.lang_pred", "j.score", "j.rejected")


def determined(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, that aren't rejected."""
    return docs.where(~judged(F.col("text"), dictionaries, min_margin)["rejected"])


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = learn(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs, dictionaries)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE_SQL: dict[str, str] = {}
