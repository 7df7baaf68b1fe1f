"""Language identification by compression.

Each language has a raw-content zstandard dictionary of text in that language. A
document is coded piece by piece with every dictionary; the language whose
dictionary gives the fewest bytes wins. A document is rejected if the best is
closer than ``margin`` to the second (relative to the second), or undetermined.

Texts are lower-cased first and every run of other characters than letters becomes
one blank, so capitals and decoration don't decide; a run of one repeated word counts once.

Learning: dictionaries are built from at most ``SAMPLE_DOCS`` labelled documents of each
language, the smallest by a hash of doc_id, and ``SAMPLE_BYTES`` of each: a bounded,
documented sample. Only text and lang are read, of documents in the training fold.

Cases: null text or text without a letter: ``und``, score 0, rejected; an empty
table gives no rows; without any labelled training document all are ``und``;
ties go to the language with more
training documents, then by name; rows that share a
doc_id are judged each by its own text; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .mixing import uniform
from .storage import document_batches, lean
from .textkernel import as_bytes

SAMPLE_DOCS = 200
SAMPLE_BYTES = 4096
DICTIONARY = 1 << 16
PIECE = 1024
LEVEL = 6
MARGIN = 0.001
UND = "und"


def held_out(doc_id="doc_id"):
    """Column: crc32 of doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def letters(text: bytes) -> str:
    """Lower-case letters of a text with their marks, one blank between their runs, a word that repeats only once; marks alone are no text."""
    import regex

    global _OTHER, _LETTER
    if _OTHER is None:
        _OTHER, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
    text = text.decode("utf-8", "replace").lower()
    if not _LETTER.search(text):
        return ""
    words = _OTHER.split(text)
    return " ".join(w for w, before in zip(words, ["", *words], strict=False) if w and w != before)


_OTHER = _LETTER = None


def build_dictionaries(samples: dict[str, list[str]], size: int = DICTIONARY) -> dict[str, bytes]:
    """Raw dictionary content of each language: half its frequent words, commonest last
    (nearest to what is coded), before them running text."""
    from collections import Counter

    out = {}
    for lang, texts in samples.items():
        clean = [t for t in (letters(as_bytes([x[:SAMPLE_BYTES]])[0]) for x in texts) if t]
        if not clean:
            continue
        share = max(64, size // 2 // len(clean))
        running = " ".join(t[:share] for t in clean).encode()[: size // 2]
        counts = Counter(w for t in clean for w in t.split())
        words = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1] * len(x[0]), x[0]))]
        held, total = [], 0
        for w in words:
            total += len(w.encode()) + 1
            if total > size // 2:
                break
            held.append(w)
        out[lang] = running + b" " + " ".join(reversed(held)).encode() + b" "
    return out


class Coder:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, piece: int = PIECE):
        import zstandard as z

        self.piece = piece
        self.coders = {}
        for lang in dictionaries:
            held = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            how = z.ZstdCompressionParameters.from_level(level, dict_size=len(dictionaries[lang]), source_size=piece, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
            held.precompute_compress(compression_params=how)
            self.coders[lang] = z.ZstdCompressor(dict_data=held, compression_params=how)

    def sizes(self, text: str) -> dict[str, int]:
        raw = text.encode()
        pieces = [raw[i : i + self.piece] for i in range(0, len(raw), self.piece)]
        return {lang: sum(len(c.compress(p)) for p in pieces) for lang, c in self.coders.items()}

    def judge(self, text: bytes) -> tuple[str, float, float]:
        """(language, score, margin)."""
        clean = letters(text)
        if not clean or not self.coders:
            return UND, 0.0, 0.0
        ranked = sorted(((n, lang) for lang, n in self.sizes(clean).items()), key=lambda x: x[0])
        best, second = ranked[0][0], ranked[1][0] if len(ranked) > 1 else 2 * ranked[0][0]
        margin = (second - best) / second
        # Bytes saved against the others, as odds: one saved byte in a piece is weak, twenty are sure.
        odds = sum(math.exp(-min(50.0, 0.25 * (n - best))) for n, _ in ranked)
        return ranked[0][1], 1.0 / odds, margin


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Dictionaries of the languages in the training fold (see the module about bounds)."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out())
    drawn = uniform(F.lit("langid"), F.col("doc_id").cast("string"))
    # A cut that leaves about twice the bound of each language, then the exact bound.
    cut = F.lit(0.0)
    sizes = sorted(labelled.groupBy("lang").count().collect(), key=lambda r: (-r["count"], r["lang"]))
    for lang, n in sizes:
        cut = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * sample_docs / n))).otherwise(cut)
    first = labelled.where(F.col("text").isNotNull() & (drawn < cut)).select("lang", F.substring("text", 1, SAMPLE_BYTES).alias("text"), drawn.alias("_u"))
    order = Window.partitionBy("lang").orderBy("_u", "text")
    rows = first.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample_docs).orderBy("lang", "_r").select("lang", "text").collect()
    samples: dict[str, list[str]] = {lang: [] for lang, _ in sizes}
    for lang, text in rows:
        samples[lang].append(text)
    return build_dictionaries(samples)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, margin double, accepted boolean"


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, accepted of every row (doc_id, text)."""
    document_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        import pyarrow as pa

        coder = Coder(held.value)
        for batch in batches:
            lang, score, gap = zip(*map(coder.judge, as_bytes(batch.column(2).to_pylist())), strict=True) if batch.num_rows else ((), (), ())
            ok = [a != UND and m >= margin for a, m in zip(lang, gap, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array(ok, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "margin", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(lean(run), SCHEMA)


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The documents whose language is sure, with all their columns."""
    document_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        coder = Coder(held.value)
        for batch in batches:
            got = [coder.judge(t) for t in as_bytes(batch.column(at).to_pylist())]
            yield batch.filter(pa.array([lang != UND and gap >= margin for lang, _, gap in got], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
