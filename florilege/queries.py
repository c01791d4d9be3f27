"""One query per operator over the test tables, with the SQL that gives the same rows.

``documents`` is the corpus (path ``documents/<doc_id>.txt``) and ``benchmark`` the batch of questions.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege.functions import scores, text
from florilege.operators import keyword, vector
from florilege.operators.chunk import bucket_counts as bucket_counts_of
from florilege.operators.chunk import chunk_documents, embed_texts
from florilege.operators.chunk_ranges import chunk_by_ranges
from florilege.operators.fusion import fuse, hybrid_search
from florilege.operators.ingest import IngestResult, digest_diff, equal_buckets, ingest, snapshot_diff
from florilege.plans import export
from florilege.plans.answer import REFUSAL, answer
from florilege.schema import CHUNKS, DOCUMENTS, AnswerOptions, ChunkOptions
from florilege.sources.folders import among, fresh_path, written
from florilege.sources.store import Collection, CollectionStore, collection_id

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_K = 20


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of a file that gives fewer tasks than there are cores, dealt out anew; a larger table stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return _spread(_table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", path.alias("path"), "text").withColumn("id", text.short_id(F.col("path")))


def _chunks(spark: SparkSession, d: str, *columns: str, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Chunks of the corpus, with the columns that the query looks at."""
    return chunk_documents(_corpus(spark, d), options, columns=columns)


def _kept(chunks: DataFrame) -> DataFrame:
    """Chunks written once, for a query that reads them several times: a reader takes its columns alone, and no executor holds them."""
    return written(chunks, "chunks")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- SQL fragments ---------------------------------------------------------------------------------------------------------
_DOC = "doc as (select doc_id, source, 'documents/' || doc_id || '.txt' as path, left(sha256('documents/' || doc_id || '.txt'), 16) as id, text from documents)"


def _chunk_sql(size: int = 220, step: int = 180) -> str:
    return rf"""{_DOC},
word as (select id, path, regexp_extract(text, '^[ \n\t\r]*') as pre, regexp_extract_all(text, '[^ \n\t\r]+[ \n\t\r]*') as w from doc),
win as (select *, unnest(range(0, (case when len(w) <= {size} then 0 else ceil((len(w) - {size}) / {step}) * {step} end)::bigint + 1, {step})) as s from word where len(w) > 0),
cut as (select id, path, s, strlen(pre) + strlen(array_to_string(w[1:s], '')) as start_offset, regexp_replace(array_to_string(w[s + 1:s + {size}], ''), '[ \n\t\r]+$', '') as text from win),
chunk as (select left(sha1(id || ':' || (row_number() over (partition by id order by s) - 1)), 16) as chunk_id, id as document_id, path as document_path, text, start_offset, start_offset + strlen(text) as end_offset from cut)"""


_TOK = "tok as (select chunk_id, regexp_extract_all(lower(text), '[A-Za-z0-9_]+') as t from chunk)"
_POST = f"{_TOK}, post as (select chunk_id, term, count(*) as tf, any_value(dl) as dl from (select chunk_id, len(t) as dl, unnest(t) as term from tok) group by chunk_id, term)"
_FNV = "list_reduce(list_transform(range(1, len(f) + 1), lambda i: ascii(substr(f, i, 1))::bigint), lambda h, b: ((xor(h, b)) * 16777619) & 4294967295, 2166136261::bigint)"


def _vector_sql(source: str, key: str, name: str) -> str:
    """Hashed unit vectors of ``source(key, t)`` as the table ``name(key, e)``, and in long form as ``name_long``."""
    return f"""{name}_f as (select {key}, unnest(list_concat(t, list_transform(range(2, len(t) + 1), lambda i: t[i - 1] || '_' || t[i]))) as f from {source}),
{name}_h as (select f, ({_FNV}) % 256 as b from (select distinct f from {name}_f)),
{name}_c as (select {key}, b, count(*) as n from {name}_f join {name}_h using (f) group by {key}, b),
{name}_n as (select {key}, sum((1 + ln(n)) * (1 + ln(n))) as norm from {name}_c group by {key}),
{name}_long as (select {key}, b as bucket, ((1 + ln(n))::float * (1 / sqrt(norm))::float)::float as weight from {name}_c join {name}_n using ({key})),
{name} as (select {key}, list(coalesce(weight, 0)::double order by r.b) as e from (select distinct {key} from {source}) cross join (select unnest(range(256)) as b) r left join {name}_long using ({key}) where coalesce({name}_long.bucket, r.b) = r.b group by {key})"""


_EMB = f"""{_TOK}, {_vector_sql("tok", "chunk_id", "cv")}""".replace("left join cv_long using (chunk_id) where coalesce(cv_long.bucket, r.b) = r.b group by chunk_id", "left join cv_long using (chunk_id, b) group by chunk_id").replace("b as bucket", "b")
_QTOK = "qtok as (select item_id as query_id, regexp_extract_all(lower(text), '[A-Za-z0-9_]+') as t from benchmark)"
_QEMB = f"""{_QTOK}, {_vector_sql("qtok", "query_id", "qv")}""".replace("left join qv_long using (query_id) where coalesce(qv_long.bucket, r.b) = r.b group by query_id", "left join qv_long using (query_id, b) group by query_id").replace("b as bucket", "b")
_BM25 = """stat as (select count(*) as n, avg(len(t)) as avg_dl from tok),
df as (select term, count(*) as df from post group by term),
qterm as (select distinct query_id, unnest(t) as term from qtok),
bm as (select query_id, chunk_id, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avg_dl))) as score
  from qterm join post using (term) join df using (term) cross join stat group by query_id, chunk_id)"""
_COS = "cs as (select query_id, chunk_id, coalesce(list_cosine_similarity(qv.e, cv.e), 0) as score from qv cross join cv)"


def _top(source: str, k: int) -> str:
    return f"(select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from {source}) where rank <= {k})"


_HYBRID = f"""with {_chunk_sql()}, {_POST}, {_QEMB}, {_EMB.removeprefix(_TOK + ", ")}, {_BM25}, {_COS},
vtop as {_top("cs", _K)}, ktop as {_top("bm", _K)},
fused as (select query_id, chunk_id, sum(1 / (60::double + rank)) as score from (select query_id, chunk_id, rank from vtop union all select query_id, chunk_id, rank from ktop) group by query_id, chunk_id),
ftop as {_top("fused", 5)}"""


#: For the queries of the jobs.
HYBRID_SQL, chunk_sql = _HYBRID, _chunk_sql


# --- scalar functions ------------------------------------------------------------------------------------------------------
@_query(f"with {_DOC} select doc_id, id, left(sha256(source), 16) as collection_id, sha256(text) as hash from doc")
def document_ids(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select("doc_id", "id", text.short_id(F.col("source")).alias("collection_id"), F.sha2("text", 256).alias("hash"))


_PATHS = ["a.md", "b.markdown", "c.pdf", "d.txt", "e.go", "f.PNG", "g.jpeg", "h.tif", "dir.d/none", "i.tar.gz", ".md", "x/.hidden", "y.", "j.proto"]


@_query(rf"""
with p as (select unnest({_PATHS!r}) as path union all select regexp_replace(url, '[?#].*$', '') from pages),
e as (select path, regexp_extract(path, '(\.[^./]*)$', 1) as ext from p)
select path, ext, case when ext in ('.md', '.markdown') then 'text/markdown' when ext = '.pdf' then 'application/pdf' when ext = '.txt' then 'text/plain' when ext = '.png' then 'image/png'
    when ext in ('.jpg', '.jpeg') then 'image/jpeg' when ext in ('.tiff', '.tif') then 'image/tiff' when ext = '.bmp' then 'image/bmp' else 'text/plain; variant=code' end as mime_type,
  case when ext in ('.md', '.markdown') then 'markdown' when ext = '.pdf' then 'pdf' when ext in ('.go', '.proto') then 'code' when ext = '.txt' then 'text'
    when lower(ext) in ('.png', '.jpg', '.jpeg', '.tiff', '.tif', '.bmp') then 'image' end as parser
from e""")
def parser_dispatch(spark: SparkSession, d: str) -> DataFrame:
    from florilege.sources.files import parser_of

    urls = _table(spark, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("path"))
    paths = spark.createDataFrame([(p,) for p in _PATHS], "path string").unionByName(urls)
    return paths.select("path", text.extension(F.col("path")).alias("ext"), text.mime_type(F.col("path")).alias("mime_type"), parser_of(F.col("path"), ocr=True).alias("parser"))


@_query("select doc_id, len(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) as n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_]+'))) as n_distinct from documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@_query("with t as (select doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9_]+') as t from documents) select doc_id, array_to_string(list_transform(range(2, len(t) + 1), lambda i: t[i - 1] || '_' || t[i]), ' ') as pairs from t")
def bigrams(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.array_join(F.slice(text.features(F.col("t")), F.size("t") + 1, F.greatest(F.size("t"), F.lit(1))), " ").alias("pairs"))


@_query(f"with t as (select distinct unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) as f from documents) select f as token, ({_FNV})::bigint as hash from t")
def fnv_hash(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token")).distinct()
    return t.select("token", text.fnv1a(F.col("token")).alias("hash"))


def _cut_sql(text: str, n: int) -> str:
    """The first n bytes and an ellipsis: as many whole characters as fit, and U+FFFD for one that the cut splits."""
    whole = f"list_max(list_filter(range(0, {n + 1}), lambda i: strlen(left({text}, i)) <= {n}))"
    cut = f"case when strlen({text}) = len({text}) then substr({text}, 1, {n}) else left({text}, {whole}) || case when strlen(left({text}, {whole})) < {n} then chr(65533) else '' end end"
    return f"(case when strlen({text}) > {n} then {cut} || '…' else {text} end)"


@_query(f"select doc_id, {_cut_sql('text', 220)} as snippet from documents")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@_query("select doc_id, trim(text, (select string_agg(chr(c::integer), '') from (select unnest(range(9, 14) || [32, 133, 160, 5760] || range(8192, 8203) || [8232, 8233, 8239, 8287, 12288]) as c))) as text from (select doc_id, chr(8195) || chr(10) || text || chr(160) || ' ' as text from documents)")
def unicode_trim(spark: SparkSession, d: str) -> DataFrame:
    """Documents with white space of all kinds put around them, trimmed."""
    padded = F.concat(F.lit("\u2003\n"), F.col("text"), F.lit("\u00a0 "))
    return _table(spark, d, "documents").select("doc_id", text.unicode_trim(padded).alias("text"))


@_query(f"with {_chunk_sql()} select chunk_id, (1 + (case when 1000 <= start_offset then 1 else 0 end) + (case when 2500 <= start_offset then 1 else 0 end) + (case when 9000 <= start_offset then 1 else 0 end))::integer as page_number from chunk")
def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    bounds = F.array(*(F.lit(x).cast("long") for x in (1000, 2500, 9000)))
    return chunk_documents(_corpus(spark, d).withColumn("boundaries", bounds), columns=("id", "page_number")).select(F.col("id").alias("chunk_id"), "page_number")


@_query(r"""
with m as (select doc_id, text, regexp_split_to_array(text, '(?m)^#{1,6}[\t\n\f\r ]|[*_`]{1,3}|!?\[|\]\([^)]*\)') as parts, regexp_extract_all(text, '(?m)^#{1,6}[\t\n\f\r ]|[*_`]{1,3}|!?\[|\]\([^)]*\)') as marks from documents)
select doc_id, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(repeat(' ', strlen(marks[i])), '')), '') as text, true as same_length from m""")
def markdown_blanking(spark: SparkSession, d: str) -> DataFrame:
    blank = text.blank_markdown(F.col("text"))
    return _table(spark, d, "documents").select("doc_id", blank.alias("text"), (F.octet_length(blank) == F.octet_length("text")).alias("same_length"))


# --- chunks and vectors ----------------------------------------------------------------------------------------------------
_CHUNK_COLUMNS = "chunk_id, document_id, document_path, start_offset::bigint as start_offset, end_offset::bigint as end_offset, text"


@_query(f"with {_chunk_sql()} select {_CHUNK_COLUMNS} from chunk")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "id", "document_id", "document_path", "start_offset", "end_offset", "text").select(F.col("id").alias("chunk_id"), "document_id", "document_path", "start_offset", "end_offset", "text")


@_query(f"with {_chunk_sql(30, 20)} select {_CHUNK_COLUMNS} from chunk")
def chunk_small(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "id", "document_id", "document_path", "start_offset", "end_offset", "text", options=ChunkOptions(30, 10)).select(F.col("id").alias("chunk_id"), "document_id", "document_path", "start_offset", "end_offset", "text")


@_query(f"with {_chunk_sql(100, 100)} select {_CHUNK_COLUMNS} from chunk")
def chunk_no_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "id", "document_id", "document_path", "start_offset", "end_offset", "text", options=ChunkOptions(100, 0)).select(F.col("id").alias("chunk_id"), "document_id", "document_path", "start_offset", "end_offset", "text")


@_query(f"with {_chunk_sql()}, {_TOK} select chunk_id, document_id, start_offset::bigint as start_offset, end_offset::bigint as end_offset, chunk.text, len(t)::integer as dl from chunk join tok using (chunk_id)")
def chunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents, each cut into ranges of a thousand characters, as those of very long ones are."""
    found = chunk_by_ranges(_corpus(spark, d), columns=("id", "document_id", "start_offset", "end_offset", "text", "dl"), chars=1000)
    return found.withColumnRenamed("id", "chunk_id")


@_query(f"with {_chunk_sql()}, {_EMB} select chunk_id, b as bucket, n from cv_c")
def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = bucket_counts_of(_chunks(spark, d, "id", "text"), "id")
    return counts.select(F.col("id").alias("chunk_id"), F.posexplode("counts").alias("bucket", "n")).where("n > 0").select("chunk_id", F.col("bucket").cast("long").alias("bucket"), "n")


@_query(f"with {_chunk_sql()}, {_EMB} select chunk_id, round(sum((1 + ln(n)) * (1 + ln(n))), 6) as squares from cv_c group by chunk_id")
def feature_weights(spark: SparkSession, d: str) -> DataFrame:
    """The squared length of each chunk's vector before it is scaled."""
    counts = bucket_counts_of(_chunks(spark, d, "id", "text"), "id").where(F.exists("counts", lambda n: n > 0))
    squares = F.aggregate("counts", F.lit(0.0), lambda s, n: s + scores.log_tf(n) * scores.log_tf(n))
    return counts.select(F.col("id").alias("chunk_id"), F.round(squares, 6).alias("squares"))


@_query(f"with {_chunk_sql()}, {_EMB} select chunk_id, b as bucket, round(weight::double, 5) as weight from cv_long")
def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "id", "embedding").select(F.col("id").alias("chunk_id"), F.posexplode("embedding").alias("bucket", "weight")).where("weight != 0")
    return rows.select("chunk_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("weight").cast("double"), 5).alias("weight"))


# --- keyword index ---------------------------------------------------------------------------------------------------------
@_query(f"with {_chunk_sql()}, {_POST} select term, chunk_id, tf, dl from post")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return keyword.postings(_chunks(spark, d, "id", "dl", "terms")).select("term", "chunk_id", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))


@_query(f"with {_chunk_sql()}, {_POST} select term, df, round(ln(1 + ((select count(*) from tok) - df + 0.5::double) / (df + 0.5::double)), 9) as idf from (select term, count(*) as df from post group by term)")
def term_idf(spark: SparkSession, d: str) -> DataFrame:
    # lengths and terms are made in passes of their own, which cost less than writing both
    both = keyword.document_frequency(_chunks(spark, d, "id", "dl", "terms")).crossJoin(F.broadcast(keyword.corpus_stats(_chunks(spark, d, "dl"))))
    return both.select("term", "df", F.round(scores.idf(F.col("n"), F.col("df")), 9).alias("idf"))


@_query(f"with {_chunk_sql()}, {_TOK} select count(*) as n, sum(len(t))::bigint as total_dl, round(avg(len(t)), 9) as avg_dl from tok")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return keyword.corpus_stats(_chunks(spark, d, "dl")).select("n", "total_dl", F.round("avg_dl", 9).alias("avg_dl"))


@_query(f"with {_chunk_sql()}, {_POST}, {_QTOK}, {_BM25} select query_id, chunk_id, round(score, 8) as score from bm")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    found = keyword.bm25_scores(_kept(_chunks(spark, d, "id", "dl", "terms")), _questions(spark, d))
    return found.select("query_id", "chunk_id", F.round("score", 8).alias("score"))


@_query(f"with {_chunk_sql()}, {_POST}, {_QTOK}, {_BM25} select query_id, chunk_id, rank::integer as rank, round(score, 8) as score from {_top('bm', _K)}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    found = keyword.KeywordIndex(_kept(_chunks(spark, d, "id", "dl", "terms"))).search(_questions(spark, d), _K)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 8).alias("score"))


@_query(f"with {_chunk_sql()}, {_TOK}, gone as (select chunk_id from chunk join doc on doc.id = document_id where doc_id % 3 = 0) select count(*) as n, sum(len(t))::bigint as total_dl from tok where chunk_id not in (select chunk_id from gone)")
def index_remove(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d, "id", "document_path", "dl")
    gone = chunks.where(F.regexp_extract("document_path", r"(\d+)", 1).cast("long") % 3 == 0).select("id")
    return keyword.corpus_stats(keyword.KeywordIndex(chunks).remove(gone).chunks).select("n", "total_dl")


# --- vector search ---------------------------------------------------------------------------------------------------------
@_query(f"""
with cs as (select a.vec_id as query_id, b.vec_id::varchar as chunk_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as score from embeddings a cross join embeddings b where a.vec_id % 20 = 0)
select query_id, chunk_id, rank::integer as rank, round(score, 8) as score from {_top("cs", 10)}""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    emb = _table(spark, d, "embeddings")
    asked = emb.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector.cosine_top_k(emb.select(F.col("vec_id").cast("string").alias("id"), "embedding"), asked, 10)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 8).alias("score"))


@_query("select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 8) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosines(spark: SparkSession, d: str) -> DataFrame:
    """Of each vector with the next, by an expression."""
    a = _table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(scores.cosine(F.col("x"), F.col("y")), 8).alias("cosine"))


@_query(f"with {_chunk_sql()}, {_QEMB}, {_EMB}, {_COS} select query_id, chunk_id, rank::integer as rank, round(score, 6) as score from {_top('cs', _K)}")
def hashed_topk(spark: SparkSession, d: str) -> DataFrame:
    found = vector.VectorIndex(_chunks(spark, d, "id", "embedding")).search(_questions(spark, d), _K)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@_query(f"with {_chunk_sql()}, {_QEMB}, {_EMB}, {_COS} select query_id, round(max(score), 6) as confidence, max(score) >= 0.4::double as answerable from cs group by query_id")
def guardrail(spark: SparkSession, d: str) -> DataFrame:
    """With a threshold that some questions miss."""
    found = vector.confidence(_chunks(spark, d, "id", "embedding"), embed_texts(_questions(spark, d), "query_id"))
    return found.select("query_id", F.round("confidence", 6).alias("confidence"), (F.col("confidence") >= 0.4).alias("answerable"))


# --- fusion and answers ----------------------------------------------------------------------------------------------------
@_query(f"{_HYBRID} select query_id, chunk_id, rank::integer as rank, round(score, 9) as score from {_top('fused', _K)}")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    chunks, asked = _kept(_chunks(spark, d, "id", "embedding", "dl", "terms")), _questions(spark, d)
    both = [vector.VectorIndex(chunks).search(asked, _K), keyword.KeywordIndex(chunks).search(asked, _K)]
    return fuse(both, _K).select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


@_query(f"{_HYBRID} select query_id, rank::integer as rank, chunk_id, document_path, round(score, 9) as score from ftop join chunk using (chunk_id)")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    chunks = _kept(_chunks(spark, d, "id", "document_path", "embedding", "dl", "terms"))
    found = hybrid_search(chunks, _questions(spark, d), 5)
    late = chunks.select(F.col("id").alias("chunk_id"), "document_path")
    return among(late, found, "chunk_id").select("query_id", "rank", "chunk_id", "document_path", F.round("score", 9).alias("score"))


def _answers(spark: SparkSession, d: str, options: AnswerOptions = AnswerOptions()) -> DataFrame:
    return answer(_kept(_chunks(spark, d, "id", "document_path", "text", "embedding", "dl", "terms")), _questions(spark, d), options)


@_query(f"""{_HYBRID}, conf as (select query_id, round(max(score), 6) as confidence from cs group by query_id)
select query_id, count(*)::integer as n_citations, string_agg(document_path, ',' order by rank) as paths, any_value(confidence) as confidence, any_value(confidence) >= 0.15 as answerable from ftop join chunk using (chunk_id) join conf using (query_id) group by query_id""")
def answers(spark: SparkSession, d: str) -> DataFrame:
    paths = F.array_join(F.transform("citations", lambda c: c["document_path"]), ",")
    return _answers(spark, d).select("query_id", F.size("citations").alias("n_citations"), paths.alias("paths"), F.round("confidence", 6).alias("confidence"), "answerable")


_FOOT = "(Local extractive mode: passages are quoted as they are; set up a generator for written answers.)"
_BREAK = "chr(10) || chr(10)"
_TEXT = f"""'Based on ' || count(*) || ' matching passage(s) in your documents:' || {_BREAK} || string_agg(rank || '. (' || document_path || ') ' || {_cut_sql("text", 400)} || {_BREAK}, '' order by rank) || '{_FOOT}'"""
_CITED = f"""string_agg('- `' || document_path || '` (score ' || printf('%.3f', score) || '): ' || replace({_cut_sql("text", 220)}, chr(10), ' ') || chr(10), '' order by rank)"""
_LISTED = "string_agg('  - ' || document_path || ' (score ' || printf('%.3f', score) || ')' || chr(10), '' order by rank)"
_REFUSAL = REFUSAL.replace("'", "''")


def _said(threshold: float) -> str:
    """Tables ``said(query_id, confidence, answerable, text, sources, listed)``; a refusal has no sources."""
    return f"""{_HYBRID}, full_text as (select query_id, {_TEXT} as text, {_CITED} as sources, {_LISTED} as listed from ftop join chunk using (chunk_id) group by query_id),
conf as (select query_id, max(score) as confidence from cs group by query_id),
said as (select query_id, confidence, confidence >= {threshold}::double as answerable, case when confidence >= {threshold}::double then full_text.text else '{_REFUSAL}' end as text,
  case when confidence >= {threshold}::double then sources end as sources, case when confidence >= {threshold}::double then listed end as listed from conf join full_text using (query_id))"""


@_query(f"{_said(0.15)} select query_id, text from said")
def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("query_id", "text")


@_query(f"{_said(0.5)} select query_id, text, answerable, round(confidence, 6) as confidence, sources is null as without_sources from said")
def refused_answers(spark: SparkSession, d: str) -> DataFrame:
    """With a threshold that some questions miss: their answers are refusals without citations."""
    found = _answers(spark, d, AnswerOptions(threshold=0.5))
    return found.select("query_id", "text", "answerable", F.round("confidence", 6).alias("confidence"), F.col("citations").isNull().alias("without_sources"))


@_query(f"{_said(0.5)} select query_id, '## Q' || query_id || ': ' || benchmark.text || {_BREAK} || said.text || {_BREAK} || coalesce('**Sources:**' || {_BREAK} || sources || chr(10), '') as section from said join benchmark on item_id = query_id")
def session_sources(spark: SparkSession, d: str) -> DataFrame:
    """Whole sections of all questions, with a threshold that some miss; a refused one has no sources."""
    sections = export.session_sections(_answers(spark, d, AnswerOptions(threshold=0.5)).withColumn("seq", F.col("query_id")))
    return sections.select(F.col("seq").alias("query_id"), "section")


@_query(f"{_HYBRID}, conf as (select query_id, max(score) as confidence from cs group by query_id) select query_id, json_keys, n_citations, first_path, confidence, answerable, refused from (select query_id, confidence >= 0.5::double as answerable, round(confidence, 6) as confidence, 'text,citations,confidence,answerable' as json_keys, case when confidence >= 0.5::double then 5 end as n_citations, case when confidence >= 0.5::double then document_path end as first_path, confidence < 0.5::double as refused from conf join ftop using (query_id) join chunk using (chunk_id) where rank = 1)")
def answer_json(spark: SparkSession, d: str) -> DataFrame:
    """The JSON of each answer, read back; a refusal's citations are null."""
    found = export.answer_json(_answers(spark, d, AnswerOptions(threshold=0.5)))
    kind = "text string, citations array<struct<chunk_id:string,document_path:string,snippet:string,score:double>>, confidence double, answerable boolean"
    back = found.select("query_id", F.array_join(F.json_object_keys("json"), ",").alias("json_keys"), F.from_json("json", kind).alias("j"))
    cited = F.when(F.col("j.citations").isNotNull(), F.size("j.citations"))
    return back.select("query_id", "json_keys", cited.alias("n_citations"), F.try_element_at(F.col("j.citations.document_path"), F.lit(1)).alias("first_path"), F.round("j.confidence", 6).alias("confidence"), "j.answerable", (F.col("j.text") == REFUSAL).alias("refused"))


@_query(f"{_said(0.5)} select query_id, text || chr(10) || coalesce(chr(10) || 'Sources:' || chr(10) || listed, '') as rendered from said")
def answer_text(spark: SparkSession, d: str) -> DataFrame:
    """With a threshold that some questions miss; a refusal has no sources."""
    return export.answer_text(_answers(spark, d, AnswerOptions(threshold=0.5)))


@_query("""with t as (select conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn) as reply, lead(role) over (partition by conv_id order by turn) as next_role from conversations)
select conv_id, turn, '## Q' || turn || ': ' || text || chr(10) || chr(10) || reply || chr(10) || chr(10) as section from t where role = 'user' and next_role = 'assistant'""")
def session_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Exchanges of conversations as sections of an export."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    turns = _table(spark, d, "conversations").withColumn("reply", F.lead("text").over(by)).withColumn("next_role", F.lead("role").over(by))
    pairs = turns.where("role = 'user' and next_role = 'assistant'")
    none = F.lit(None).cast("array<struct<chunk_id:string,document_path:string,snippet:string,score:double>>")
    exchanges = pairs.select("conv_id", "turn", F.col("turn").alias("seq"), F.col("text").alias("question"), F.col("reply").alias("text"), none.alias("citations"), F.lit(True).alias("answerable"))
    return export.session_sections(exchanges, "conv_id", "turn").drop("seq")


# --- ingestion -------------------------------------------------------------------------------------------------------------
_DIFF = """disk as (select id, path, sha256(text) as hash from doc where doc_id % 7 != 0),
stored as (select id, path, case when doc_id % 5 = 0 then sha256('old') else sha256(text) end as hash from doc where doc_id % 3 != 0),
diff as (select coalesce(d.id, s.id) as id, coalesce(d.path, s.path) as path, case when d.id is null then 'removed' when s.id is null then 'added' when d.hash = s.hash then 'unchanged' else 'updated' end as status from disk d full join stored s on d.id = s.id)"""


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The corpus without some documents, and the corpus without others and with some altered."""
    docs = _corpus(spark, d)
    disk = docs.where("doc_id % 7 != 0").withColumn("hash", F.sha2("text", 256))
    stored = docs.where("doc_id % 3 != 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("text", 256)))
    return disk, stored


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff(*_states(spark, d))


@_query(f"with {_DOC}, {_DIFF} select id, path, status from diff")
def ingest_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).select("id", "path", "status")


@_query(f"with {_DOC}, {_DIFF} select id, path, status from diff")
def ingest_digests(spark: SparkSession, d: str) -> DataFrame:
    """The same difference, where buckets of ids that are equal on both sides are not joined."""
    disk, stored = _states(spark, d)
    equal = equal_buckets(disk, stored, 256)
    return digest_diff(disk, stored, equal, buckets=256).select("id", "path", "status")


@_query(f"with {_DOC}, {_DIFF} select " + ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("added", "updated", "unchanged", "skipped", "error", "removed")) + " from diff")
def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    return export.ingest_report(_diff(spark, d))


@_query(f"with {_chunk_sql()}, {_DIFF} select chunk_id from chunk where document_id not in (select id from diff where status in ('removed', 'updated'))")
def prune_chunks(spark: SparkSession, d: str) -> DataFrame:
    gone = _diff(spark, d).where(F.col("status").isin("removed", "updated")).select(F.col("id").alias("document_id"))
    return _chunks(spark, d, "id", "document_id").join(gone, "document_id", "left_anti").select(F.col("id").alias("chunk_id"))


@_query(f"with {_chunk_sql()}, per as (select document_id, count(*) as n from chunk group by document_id) select source, count(*) as doc_count, coalesce(sum(n), 0)::bigint as chunk_count from doc left join per on id = document_id group by source")
def collection_summary(spark: SparkSession, d: str) -> DataFrame:
    return export.collection_summary(_corpus(spark, d).select("id", "source"), _chunks(spark, d, "document_id"), "source")


@_query(f"with {_chunk_sql()}, per as (select document_id, count(*) as n from chunk group by document_id), c as (select source, count(*) as docs, coalesce(sum(n), 0)::bigint as chunks from doc left join per on id = document_id group by source) select printf('%-20s  %5d docs  %6d chunks  root=%s', source, docs, chunks, 'documents') as line from c")
def collection_listing(spark: SparkSession, d: str) -> DataFrame:
    c = collection_summary(spark, d)
    return c.select(export.listing_line(F.col("source"), F.col("doc_count"), F.col("chunk_count"), F.lit("documents")).alias("line"))


def _stored(spark: SparkSession, d: str, *columns: str) -> Collection:
    """A collection of documents in other states than on disk: some are missing, some have other texts, some are left over."""
    docs = _corpus(spark, d).where("doc_id % 3 != 0")
    old = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.lit("an older text")).otherwise(F.col("text")))
    state = Collection(collection_id("corpus"), "corpus", "documents", *(spark.createDataFrame([], s) for s in (DOCUMENTS, CHUNKS)))
    state.documents = old.select("id", "path", F.sha2("text", 256).alias("hash"), text.mime_type(F.col("path")).alias("mime_type"), F.lit(None).cast("timestamp").alias("indexed_at"))
    state.chunks = chunk_documents(old, columns=columns or tuple(CHUNKS.names))
    return state


def _files(spark: SparkSession, d: str) -> DataFrame:
    """All documents as files, but for some that are gone, cannot be read, or have a name that no parser claims."""
    path = F.when(F.col("doc_id") % 11 == 1, F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".bin"))).otherwise(F.col("path"))
    unread = F.col("doc_id") % 13 == 2
    return _corpus(spark, d).where("doc_id % 7 != 0").select(path.alias("path"), F.when(~unread, F.col("text").cast("binary")).alias("content"), F.when(unread, F.lit("no permission")).alias("error"))


def _ingested(spark: SparkSession, d: str, *columns: str) -> IngestResult:
    """An ingestion, whose chunks have the columns that the query looks at."""
    return ingest(_stored(spark, d, *columns), _files(spark, d), columns=columns or tuple(CHUNKS.names))


_INGEST = """disk as (select id, path, text, sha256(text) as hash from doc where doc_id % 7 != 0 and doc_id % 11 != 1 and doc_id % 13 != 2),
stored as (select id, path, case when doc_id % 5 = 0 then 'an older text' else text end as text from doc where doc_id % 3 != 0),
state as (select coalesce(d.id, s.id) as id, coalesce(d.path, s.path) as path, case when d.id is null then 'removed' when s.id is null then 'added' when d.text = s.text then 'unchanged' else 'updated' end as status from disk d full join stored s on d.id = s.id)"""


@_query(f"""with {_DOC}, {_INGEST} select path, status, null::varchar as error from state
union all select 'documents/' || doc_id || '.bin', 'skipped', null from doc where doc_id % 7 != 0 and doc_id % 11 = 1
union all select path, 'error', 'no permission' from doc where doc_id % 7 != 0 and doc_id % 11 != 1 and doc_id % 13 = 2""")
def ingest_run(spark: SparkSession, d: str) -> DataFrame:
    """What a whole ingestion reports: files added, updated, unchanged, removed, skipped and not read."""
    return _ingested(spark, d).report


@_query(f"""with {_chunk_sql()}, {_INGEST} select chunk_id, document_path, start_offset::bigint as start_offset, text from chunk where document_id in (select id from state where status in ('added', 'updated', 'unchanged'))""")
def ingest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a collection after an ingestion: kept ones and new ones."""
    found = _ingested(spark, d, "id", "document_id", "document_path", "start_offset", "text").collection.chunks
    return found.select(F.col("id").alias("chunk_id"), "document_path", "start_offset", "text")


def _saved(spark: SparkSession, d: str) -> Collection:
    """A collection saved in one state, and brought up to date by a second segment."""
    store = CollectionStore(spark, fresh_path(spark, "collections"))
    old = store.save(_stored(spark, d))
    try:
        result = ingest(old, _files(spark, d), stage=lambda rows, label: store.staging(old.id, label, rows))
        return store.append(old.id, result.delta)
    finally:
        store.clear()


_KEPT = f"""{_chunk_sql()}, {_INGEST},
new_chunk as (select * from chunk where document_id in (select id from state where status in ('added', 'updated', 'unchanged')))"""
_KEPT_POST = _POST.replace("from chunk", "from new_chunk")


@_query(f"""with {_KEPT} select document_path, count(*) as n_chunks, min(chunk_id) as first_chunk, sum(strlen(text))::bigint as n_bytes from new_chunk group by document_path""")
def stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a collection that was saved, and then brought up to date through the store."""
    return _saved(spark, d).chunks.groupBy("document_path").agg(F.count("*").alias("n_chunks"), F.min("id").alias("first_chunk"), F.sum(F.octet_length("text")).alias("n_bytes"))


@_query(f"with {_KEPT}, {_KEPT_POST}, {_QTOK} select term, chunk_id, tf, dl from post where term in (select unnest(t) from qtok)")
def stored_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings of all terms of the questions, out of the stored index of two segments."""
    found = _saved(spark, d).index.postings(keyword.question_terms(_questions(spark, d)))
    return found.select("term", "chunk_id", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))


@_query(f"""with {_KEPT}, {_KEPT_POST}, {_QTOK}, s as (select count(*) as n, sum(len(t))::bigint as total_dl from tok)
select term, count(*) as df, any_value(n) as n, any_value(total_dl) as total_dl from post cross join s where term in (select unnest(t) from qtok) group by term""")
def stored_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the questions' terms, kept up over two segments instead of counted anew."""
    index = _saved(spark, d).index
    n, total = index.corpus_stats()
    return index.document_frequency(keyword.question_terms(_questions(spark, d))).select("term", "df", F.lit(n).cast("long").alias("n"), F.lit(total).cast("long").alias("total_dl"))


@_query(f"with {_KEPT}, {_KEPT_POST}, {_QTOK}, {_BM25} select query_id, chunk_id, rank::integer as rank, round(score, 8) as score from {_top('bm', _K)}")
def stored_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks by BM25 out of the stored index, most postings left unscored."""
    found = _saved(spark, d).index.search(_questions(spark, d), _K)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 8).alias("score"))


@_query(f"with {_DOC} select path, trim(translate(text, chr(10) || chr(13), '  ')) as text, 0 as n_boundaries, null::varchar as error from doc")
def pdf_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as one-stream PDFs by an expression and read back by the parser."""
    from florilege.sources.files import parse

    shown = F.regexp_replace(F.regexp_replace("text", r"([\\()])", r"\\$1"), r"[\r\n]", " ")
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Length 1 >>\nstream\nBT ("), shown, F.lit(") Tj ET\nendstream\nendobj\n"))
    files = _corpus(spark, d).select("path", body.cast("binary").alias("content"), F.lit("pdf").alias("parser"))
    return parse(files).select("path", "text", F.size("boundaries").alias("n_boundaries"), "error")


@_query(rf"""with {_DOC}, p as (select path, doc_id, trim(translate(text, chr(10) || chr(13), '  ')) as one, 'siehe [1 Quelle ' || source as two from doc)
select path, case when one = '' then two else one || chr(10) || chr(10) || two end as text, case when one = '' then [] else [strlen(one) + 2] end::bigint[] as boundaries, null::varchar as error from p""")
def pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as PDFs of three streams, half of them deflated, and read back: the second has an open bracket and an array, the third no text."""
    from collections.abc import Iterator

    from florilege.sources.files import parse

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            made = []
            for doc_id, source, shown in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                pages = [f"BT ({shown}) Tj ET", f"BT (siehe [1) Tj [(Quelle) -250 (\\040{source[:2]}) 3 ({source[2:]})] TJ ET", "q 1 0 0 1 re"]
                out = b"%PDF-1.4\n"
                for page in pages:
                    body, how = page.encode(), b""
                    if doc_id % 2:
                        body, how = zlib.compress(body), b" /Filter /FlateDecode"
                    out += b"1 0 obj\n<< /Length 1" + how + b" >>\nstream\n" + body + b"\r\nendstream\nendobj\n"  # a carriage return of its own, lest one that ends the body be taken for it
                made.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array(["pdf"] * len(made))], ["path", "content", "parser"])

    shown = F.regexp_replace(F.regexp_replace("text", r"([\\()])", r"\\$1"), r"[\r\n]", " ")
    files = _corpus(spark, d).select("path", "doc_id", "source", shown).mapInArrow(write, "path string, content binary, parser string")
    return parse(files).select("path", "text", "boundaries", "error")
