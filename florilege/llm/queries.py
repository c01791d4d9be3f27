"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.llm.storage import fresh_path, tidy

RANKS, VOCABULARY, PIECES = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"


#: Bytes of a shard: small enough for many shards, of several depths, at any size of the tables here.
SHARD_BYTES = 256 << 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@tidy
def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from florilege.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


@tidy
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from florilege.llm.quality import classify_documents

    return classify_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from florilege.llm.pii import find_in_documents

    return find_in_documents(_table(spark, sf_dir, "documents"))


@tidy
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from florilege.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), SHARD_BYTES)


@tidy
def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from florilege.llm.rules import judge_documents

    return judge_documents(_table(spark, sf_dir, "documents"))


@tidy
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from florilege.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from florilege.llm.byte_bpe import digest_documents

    return digest_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@tidy
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from florilege.llm.warc import assemble, read_archives, with_revisits, write_archives

    path = fresh_path(spark, "warc")
    write_archives(with_revisits(_table(spark, sf_dir, "pages")), path)
    captures = assemble(read_archives(spark, path, payloads=False))
    return captures.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to", F.size("metadata").alias("n_metadata"), F.col("request").isNotNull().alias("has_request"))


@tidy
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from florilege.llm.lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


@tidy
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from florilege.llm.jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from florilege.llm.piece_bpe import digest_documents

    return digest_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@tidy
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from florilege.llm.lexical import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_neardup": op1_embedding_neardup,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_sharding": op4_sharding,
    "op5_rules": op5_rules,
    "op6_packing": op6_packing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_warc": op8_warc,
    "op9_lm_score": op9_lm_score,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_piece_bpe": op11_piece_bpe,
    "op12_lexical_search": op12_lexical_search,
}

_OP12_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as t from documents
), i as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) as term from benchmark
), q as (select item_id, term, count(*) as times from i group by item_id, term
), s as (select count(*) as docs, sum(len(t))::bigint as total from d where len(t) > 0
), p as (select doc_id, any_value(len(t)) as n, term, count(*) as tf from (select doc_id, t, unnest(t) as term from d) where term in (select term from q) group by doc_id, term
), w as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from p cross join s group by term
), r as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::bigint as score
  from q join p using (term) join w using (term) cross join s group by item_id, doc_id
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score from r where score > 0
qualify rank <= 20
"""

_OP1_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0
), links as (
  select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id != b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95
), reach(u, v) as (
  select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u
), n as (select u, count(*) as n_links from links group by u), c as (select u, min(v) as least from reach group by u)
select vec_id, coalesce(n_links, 0)::bigint as n_links, least(vec_id, coalesce(least, vec_id)) as component_id,
  vec_id = least(vec_id, coalesce(least, vec_id)) as kept
from embeddings left join n on n.u = vec_id left join c on c.u = vec_id
"""

_OP4_SQL = f"""
with d as (
  select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from documents
), p as (
  select doc_id, n_bytes, k::integer as k, h >> (32 - k)::integer as prefix from d, range(0, 33) as r(k)
), b as (
  select k, prefix, sum(n_bytes)::bigint as shard_bytes, count(*) as shard_docs from p group by k, prefix
), s as (
  select doc_id, min(k) as depth from p join b using (k, prefix) where shard_bytes <= {SHARD_BYTES} or shard_docs = 1 group by doc_id
)
select p.doc_id, p.n_bytes, s.depth, lpad(case when s.depth = 0 then '' else bin(p.prefix) end, s.depth, '0') as shard, b.shard_bytes, b.shard_docs
from p join s on p.doc_id = s.doc_id and p.k = s.depth join b on b.k = p.k and b.prefix = p.prefix
"""

_OP8_SQL = """
with p as (
  select page_id, sha256(coalesce(html, '')) as payload_digest, strlen(coalesce(html, ''))::bigint as payload_bytes from pages
), m as (select payload_digest, min(page_id) as first_page from p group by payload_digest)
select page_id, payload_bytes, p.payload_digest,
  case when payload_bytes >= 100 and page_id != first_page then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id != first_page then first_page end as refers_to, 1::integer as n_metadata, true as has_request
from p join m using (payload_digest)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_neardup": _OP1_SQL,
    "op4_sharding": _OP4_SQL,
    "op8_warc": _OP8_SQL,
    "op12_lexical_search": _OP12_SQL,
}
