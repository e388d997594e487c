"""Language of a text by how well it compresses with a dictionary of each language.

Method: per language a raw-content zstandard dictionary is cut from labelled texts. A text
is lowered, compressed with every dictionary and goes to the one with the smallest result; a narrow
margin to the second is reported as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillhouse.llm.common import types

# The labelled sample is bounded: per language so many different texts, or all if there are
# fewer, and of each at most so many characters from its middle.
SAMPLE_TEXTS = 160
SAMPLE_CHARS = 800
LEVEL = 6
# A text is compressed in pieces so that the dictionary counts to its end.
PIECE_BYTES = 16 << 10
MIN_MARGIN = 0.01
NO_LETTERS = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(labelled: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionary bytes per language from ``labelled`` (``doc_id``, ``text``, ``lang``).

    Which texts are sampled depends on a hash of the text alone, so that repeated texts
    count once, however many rows have them. Rows without text or language are left out;
    no rows give no language.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", F.lower("text").alias("text")
    )
    drawn = F.xxhash64("text")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count_distinct(drawn).alias("n")).collect()}
    wide = 1 << 30
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - chars) / 2).cast("int") + 1)
    part = F.substr("text", middle, F.lit(chars)).alias("part")
    shares = {lang: min(wide, wide * 2 * texts // n + 1) for lang, n in counts.items()}
    parts: dict[str, list[tuple[int, str]]] = {}
    while shares:
        share = F.create_map(*[F.lit(x) for item in shares.items() for x in item])
        rows = (
            usable.withColumn("_drawn", F.pmod(drawn, F.lit(wide)))
            .filter(F.col("_drawn") < F.element_at(share, F.col("lang")))
            .select("lang", "_drawn", part)
            .distinct()
            .collect()  # about 2 * texts rows of `chars` characters per language
        )
        parts |= {lang: [] for lang in shares}
        for row in rows:
            parts[row["lang"]].append((row["_drawn"], row["part"]))
        # A language that drew too few by chance is drawn again, twice as wide.
        shares = {
            lang: min(wide, 2 * n) for lang, n in shares.items() if n < wide and len(parts[lang]) < min(texts, counts[lang])
        }
    # zstandard finds the end of a dictionary cheapest, hence the shortest part goes last.
    return {
        lang: "\n".join(sorted((p for _, p in sorted(found)[:texts]), key=len, reverse=True)).encode()
        for lang, found in sorted(parts.items())
    }


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``lang_pred``, ``score``, ``rejected``.

    The score is 1 - smallest / second smallest size, from 0 (a tie; the first language in
    alphabetical order is taken) to 1. A null text, one without a letter, and any text when
    no language was learned, is ``und`` with score 0. With a single language the score is
    1. Other columns are ignored; repeated rows are judged each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # some 100 KB per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, coders = [], []
        for name, content in sorted(shared.value.items()):
            model = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            model.precompute_compress(level=LEVEL)
            coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=model, write_content_size=False, write_dict_id=False)
            names.append(name)
            coders.append(coder.compress)
        for batch in batches:
            langs, scores = [], []
            for text, letters in zip(batch.column(1), batch.column(2)):
                if not names or not letters.as_py():
                    langs.append(NO_LETTERS)
                    scores.append(0.0)
                    continue
                data = text.as_buffer()
                pieces = [data.slice(at, min(PIECE_BYTES, data.size - at)) for at in range(0, data.size, PIECE_BYTES)]
                sizes = sorted((sum(len(coder(p)) for p in pieces), name) for coder, name in zip(coders, names))
                langs.append(sizes[0][1])
                scores.append(1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    out = docs.select("doc_id", F.lower("text").alias("text"), letters).mapInArrow(run, types(docs, "doc_id", lang_pred="string", score="double"))
    return out.withColumn("rejected", (F.col("score") < min_margin) | (F.col("lang_pred") == NO_LETTERS))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all.

    Columns: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``rejected``.
    """
    dictionaries = learn(docs.filter(~held_out()))
    out = predict(docs, dictionaries)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
