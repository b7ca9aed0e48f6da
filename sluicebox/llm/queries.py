"""The registered queries of this subpackage, and the SQL each must equal where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staging_path
from .alignment import align
from .bpe import digests
from .common import prepare, stage, table
from .fingerprint import as_text, edited_likeness
from .language import languages, learn
from .licenses import _HELD, _HOLDER, _SPDX_LINE, _WRAPPED, CONTAINED, PARTS, SEQUENCES, scan
from .minhash import near_duplicates
from .neighbours import nearest
from .packing import pack, token_pieces
from .pii import pseudonymised, session_key
from .quality import quality_scores
from .toxicity import language_thresholds, threshold_of, toxicity_scores, train_model
from .warc import read_records, write_archives
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql:
            SQL[name] = sql
        return fn

    return register


@query(
    "op1_minhash",
    r"""
    WITH RECURSIVE worded AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w
      FROM documents
    ), shingled AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
      FROM worded
    ), sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
    ), shared AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY ALL
    ), links AS (
      SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
      WHERE 100 * common >= 75 * (p.n + q.n - common)
    ), reach AS (
      SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
    ), classes AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN classes ON x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
    """,
)
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces, packed into sequences of 4096 tokens."""
    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)
    return pack(pieces)


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's byte-level BPE ids and the text decoded from them, as digests."""
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    "op5_warc",
    """
    WITH payloads AS (
      SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages
    ), tops AS (SELECT p, max(page_id) AS top FROM payloads GROUP BY p)
    SELECT page_id, octet_length(encode(p)) AS payload_bytes,
      array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * g + 1, 5) AS BIGINT) >> s) & 31 AS INT) + 1, 1)
        FOR s IN [15, 10, 5, 0]], '') FOR g IN range(8)], '') AS payload_digest,
      CASE WHEN page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
    FROM payloads JOIN tops USING (p)
    """,
)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to web archives and read back through the index."""
    index = write_archives(table(spark, sf_dir, "pages"), staging_path(spark, "warc"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_fingerprint")
def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    found = edited_likeness(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("prints")).alias("fingerprint"), as_text(F.col("edited_prints")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


@query(
    "op7_neighbours",
    """
    WITH v AS (
      SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
      WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding)
        AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    ), ranked AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
)
def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.where(F.col("vec_id") % 100 == 0), vectors)


def taught(modulus: int, held_out: int, id_col: str = "id") -> Column:
    """Whether a row's label may be learned from: the CRC-32 of its id as text leaves another remainder than ``held_out``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus != held_out


def is_held_out(modulus: int, remainder: int, id_col: str = "doc_id") -> Column:
    """Whether an id leaves ``remainder``; a null id leaves none, and nothing is learned from its row either."""
    return F.coalesce(~taught(modulus, remainder, id_col), F.lit(False)).alias("held_out")


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by the fixed threshold and by that of its language, which is calibrated on the rows that may be learned from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = stage(toxicity_scores(docs, train_model(docs, labels, taught(4, 2)), keep=("lang",)), "toxicity")
    known = labels.where(taught(4, 2, "doc_id")).where("toxic IN (0, 1)").select("doc_id", F.col("toxic").alias("label")).distinct()
    limit = threshold_of(F.col("lang"), language_thresholds(scores.join(known, "doc_id")))
    return scores.select(
        "doc_id", is_held_out(4, 2), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
        limit.alias("threshold"), F.when(F.col("score") >= limit, 1).otherwise(0).alias("calibrated"),
    )


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = quality_scores(docs, labels, taught(5, 0, "doc_id"))
    return scores.drop("row").select("doc_id", is_held_out(5, 0), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms."""
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


def _license_sql() -> str:
    known = ", ".join(f"('{part}', '{name}')" for part, name in PARTS.items())
    rule = {
        r: " OR ".join(f"regexp_matches(known, '{',' + ',(?:.*,)?'.join(re.escape(i) for i in way) + ','}')" for way in ways) for r, ways in SEQUENCES.items()
    }
    names = ", ".join(f"CASE WHEN ({rule[r]}){''.join(f' AND NOT ({rule[o]})' for o in CONTAINED[r])} THEN '{r}' END" for r in SEQUENCES)
    text = rf"regexp_replace(regexp_replace(lower(coalesce(text, '')), '{_SPDX_LINE}', chr(1) || 'spdx \1' || chr(1), 'g'), '[.!?;:]+(\s+|$)', chr(1), 'g')"

    def held(words: str) -> str:
        return f"regexp_replace({words}, '^{_HOLDER}$', '{_HELD}')"

    return rf"""
    WITH known(part, name) AS (VALUES {known}
    ), flowing AS (
      SELECT doc_id, unnest(string_split({text}, chr(1))) AS s, generate_subscripts(string_split({text}, chr(1)), 1) AS i FROM documents
    ), whole AS (
      SELECT doc_id, i, s, name FROM flowing LEFT JOIN known ON part = {held("trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))")}
    ), lines AS (
      SELECT doc_id, i, trim(regexp_replace(regexp_replace(s, '[^a-z0-9\n]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')) AS l FROM whole WHERE name IS NULL
    ), runs AS (
      SELECT doc_id, i, unnest(regexp_extract_all(l, '{_WRAPPED}')) AS run, generate_subscripts(regexp_extract_all(l, '{_WRAPPED}'), 1) AS j FROM lines
    ), pieces AS (
      SELECT doc_id, i, j, replace(run, chr(10), ' ') AS part, 1000000 AS k FROM runs
      UNION ALL SELECT doc_id, i, j, unnest(string_split(run, chr(10))), generate_subscripts(string_split(run, chr(10)), 1) FROM runs WHERE contains(run, chr(10))
    ), found AS (
      SELECT doc_id, i, 0 AS j, 0 AS k, name FROM whole WHERE name IS NOT NULL
      UNION ALL SELECT doc_id, i, j, k, known.name FROM pieces JOIN known ON known.part = {held("pieces.part")}
    ), joined AS (
      SELECT d.doc_id, coalesce(sentences, '') AS sentences, ',' || coalesce(sentences, '') || ',' AS known
      FROM documents d LEFT JOIN (SELECT doc_id, string_agg(name, ',' ORDER BY i, j, k) AS sentences FROM found GROUP BY doc_id) f USING (doc_id)
    )
    SELECT doc_id, sentences, concat_ws(',', {names}) AS licenses FROM joined
    """


@query("op10_licenses", _license_sql())
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence sentences and licences of every document."""
    return scan(table(spark, sf_dir, "documents"))


@query("op11_language")
def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = table(spark, sf_dir, "documents")
    found = languages(docs, learn(docs, taught(3, 1, "doc_id")))
    return found.select("doc_id", is_held_out(3, 1), "lang_pred", "score")


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the four directions of most variance, whitened."""
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two public tokenizers line up in every document."""
    docs = table(spark, sf_dir, "documents")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
