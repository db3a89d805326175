"""Queries of the search and retrieval operators, and DuckDB SQL for them."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsift.functions import text as X
from docsift.operators import bm25, dedup, inventory, ivf, membership, metadata, name_index, names, postings, retrieval, sections, segments
from docsift.sources import store, versions
from docsift.sources.files import html_text

QUERY = "the with of nation ing"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one, or in the warehouse, unless that is on the local disks of a cluster."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    at = given or spark.conf.get("spark.sql.warehouse.dir")
    if not given and (at.startswith("file:") or ":" not in at) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{at.rstrip('/')}/docsift-{name}-{uuid.uuid4().hex}"


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9_./-]+')"
_BM25 = f"""
toks as (select doc_id, {_TOKENS} t from documents),
stat as (select count(*) n, sum(len(t)) / count(*) avgdl from toks),
q as (select unnest(['the', 'with', 'of', 'nation', 'ing']) term),
tf as (select doc_id, len(t) dl, q.term, len(list_filter(t, lambda x: x = q.term)) f from toks, q),
idf as (select term, ln(1 + (any_value(n) - count(*) filter (where f > 0) + 0.5) / (count(*) filter (where f > 0) + 0.5)) idf from tf, stat group by term),
scored as (select doc_id, round(sum(idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / (avgdl + 1e-9)) + 1e-9)), 6) score
           from tf join idf using (term), stat group by doc_id),
sparse as (select doc_id, score from scored order by score desc, doc_id limit 30)"""


@query(f"with {_BM25} select * from sparse")
def bm25_topk(spark, d):
    return bm25.top_k(table(spark, d, "documents"), "doc_id", "text", QUERY, 30, counts_at=scratch(spark, "bm25-counts"))


@query(f"with {_BM25} select * from sparse where score > 0")
def bm25_indexed_topk(spark, d):
    path = scratch(spark, "bm25")
    bm25.build_index(table(spark, d, "documents"), "doc_id", "text", path)
    return bm25.search_index(spark, path, "doc_id", QUERY, 30)


@query(f"select term, count(distinct doc_id) df from (select doc_id, unnest({_TOKENS}) term from documents) group by 1")
def token_df(spark, d):
    return bm25.document_frequency(table(spark, d, "documents"), "doc_id", "text")


@query(f"select doc_id, term, count(*) tf from (select doc_id, unnest({_TOKENS}) term from documents) group by 1, 2")
def bm25_postings(spark, d):
    return bm25.postings(table(spark, d, "documents"), "doc_id", "text")


def _names(spark, d, q):
    return table(spark, d, "part").where(names.compile_query(q, F.col("p_name"))).select("p_partkey", "p_name")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'ring')")
def name_contains(spark, d):
    return _names(spark, d, "Ring")


@query("select p_partkey, p_name from part where regexp_matches(p_name, 'ring.*small|small.*ring', 'i')")
def name_star_unordered(spark, d):
    return _names(spark, d, "ring*small")


@query("select p_partkey, p_name from part where regexp_matches(p_name, 's.*l.*g.*', 'i')")
def name_star_general(spark, d):
    return _names(spark, d, "s*l*g*")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'r') and not regexp_matches(p_name, 'w.*t|t.*w', 'i')")
def name_percent_exclude(spark, d):
    return _names(spark, d, "r % w*t")


_FUZZY = """with terms as (select unnest(['ring', 'small', 'smoll']) term),
n as (select distinct lower(p_name) fit from part),
p as (select fit, term, case when length(term) <= length(fit) then term else fit end s, case when length(term) <= length(fit) then fit else term end t from n, terms
      union all select fit, term, fit, term from n, terms where length(fit) = length(term)),
w as (select fit, term, s, substr(t, greatest(0, g)::bigint + 1, (g + length(s) - greatest(0, g))::bigint) w from p, range(-60, 200) r(g) where g >= 1 - length(s) and g < length(t)),
l as (select fit, term, length(s) n, length(w) m, list_reduce(list_transform(string_split(w, ''), lambda a: list_transform(string_split(s, ''), lambda b: (a = b)::int)),
      lambda old, x: list_transform(range(1, len(x) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(old[i], case when x[i] = 1 then coalesce(old[i - 1], 0) + 1 else 0 end)))),
      list_transform(range(length(s)), lambda z: 0::int))[-1] common from w),
fits as (select fit from (select fit, term, max(200.0 * common / (n + m)) ratio from l group by 1, 2) group by 1 having min(ratio) >= 70)
select p_partkey, p_name from part where lower(p_name) in (select fit from fits)"""


@query(_FUZZY)
def fuzzy_all_terms(spark, d):
    rows = table(spark, d, "part")
    return rows.where(names.fuzzy("@smoll ring", F.col("p_name"), {"smoll": ["small"]})).select("p_partkey", "p_name")


def _indexed(spark, d, q, synonyms=None):
    at = scratch(spark, "names")
    name_index.build(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", at)
    return name_index.load(spark, at).search(q, synonyms).select(F.col("key").alias("p_partkey"), F.col("name").alias("p_name"))


@query(_FUZZY)
def fuzzy_indexed(spark, d):
    return _indexed(spark, d, "@smoll ring", {"smoll": ["small"]})


@query(SQL["name_star_unordered"])
def name_star_indexed(spark, d):
    return _indexed(spark, d, "ring*small")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'ring') and not regexp_matches(p_name, 'w.*t|t.*w', 'i')")
def name_percent_indexed(spark, d):
    return _indexed(spark, d, "ring % w*t")


@query("""select * from (select octet_length(encode(text)) size, sha256(text) hash, doc_id as "member", count(*) over (partition by sha256(text), octet_length(encode(text))) n from documents) where n > 1""")
def dup_groups(spark, d):
    return dedup.duplicate_groups(table(spark, d, "documents").withColumn("size", F.octet_length("text").cast("long")), "size", "text", "doc_id")


@query("select count(*) n_groups, sum(n)::bigint n_files, max(n) most from (select count(*) n from documents group by text having count(*) > 1)")
def dup_totals(spark, d):
    return dedup.duplicate_totals(table(spark, d, "documents").withColumn("size", F.octet_length("text").cast("long")), "size", "text")


_FOLD = r"lower(regexp_replace(regexp_replace(text, '^[\s\v\x1c-\x1f\x{85}\x{a0}]+|[\s\v\x1c-\x1f\x{85}\x{a0}]+$', '', 'g'), '[\s\v\x1c-\x1f\x{85}\x{a0}]+', ' ', 'g'))"


@query(f"select sha1({_FOLD}) chunk_hash, min(doc_id) doc_id from documents where {_FOLD} != '' group by 1")
def chunk_hash_dedup(spark, d):
    return dedup.first_seen(table(spark, d, "documents"), "text", ["doc_id"])


@query(f"""with h as (select source, doc_id, sha1({_FOLD}) h, {_FOLD} = '' blank from documents),
m as (select *, not blank and row_number() over (partition by h order by doc_id) > 1 dup from h)
select source, count(*) n_chunks, count(*) filter (where dup) n_dup, round(count(*) filter (where dup) / count(*), 6) ratio,
count(*) filter (where dup) >= 0.8 * count(*) skipped from m group by 1""")
def dup_ratio_skip(spark, d):
    return dedup.duplicate_ratio(table(spark, d, "documents"), "source", "text", ["doc_id"])


@query(r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
          '^[\s\v\x1c-\x1f]+|[\s\v\x1c-\x1f]+$', '', 'g') text from documents""")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("text"))


_BLOCKS = r"""
placed as (select doc_id, i pos, l[i] line from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x != '') l from documents), range(1, 100000) r(i) where i <= len(l)),
kinds as (select *, case when regexp_matches(line, '^\s*(\d+(\.\d+)*)\s*[.)-]?\s+(.+)$') or (regexp_matches(line, '\p{Lu}') and not regexp_matches(line, '[\p{Ll}\p{Lt}]') and length(line) between 6 and 120) then 'h'
  when line like '%:' and length(line) <= 120 then 's' else '' end kind from placed),
marked as (select *, sum(case when kind != '' or pos = 1 then 1 else 0 end) over (partition by doc_id order by pos) blk from kinds),
grouped as (select doc_id, blk, min(pos) pos, string_agg(line, chr(10) order by pos) text, arg_min(kind, pos) kind, arg_min(line, pos) line from marked group by 1, 2),
blocks as (select doc_id, (blk - 1)::int block, coalesce(last_value(case when kind = 'h' then line end ignore nulls) over (partition by doc_id order by pos), '') section,
  case when kind = 's' then regexp_replace(line, ':+$', '') else '' end subsection, text from grouped)"""


@query(f"with {_BLOCKS} select * from blocks")
def section_blocks(spark, d):
    rows = sections.with_blocks(table(spark, d, "documents").select("doc_id", "text"))
    # outer, because the filter that Spark infers for an inner one computes all blocks a second time
    return rows.select("doc_id", F.posexplode_outer("blocks").alias("block", "b")).where("block is not null").select("doc_id", "block", "b.section", "b.subsection", "b.text")


@query(f"""with recursive {_BLOCKS},
fold as (
  select doc_id, block, section, subsection, text, 0 chunk, length(text) >= 900 closed from blocks where block = 0
  union all
  select b.doc_id, b.block,
    case when f.closed or length(f.text) + 2 + length(b.text) > 1300 then b.section else f.section end,
    case when f.closed or length(f.text) + 2 + length(b.text) > 1300 then b.subsection else f.subsection end,
    case when f.closed or length(f.text) + 2 + length(b.text) > 1300 then b.text else f.text || chr(10) || chr(10) || b.text end,
    f.chunk + case when f.closed or length(f.text) + 2 + length(b.text) > 1300 then 1 else 0 end,
    length(case when f.closed or length(f.text) + 2 + length(b.text) > 1300 then b.text else f.text || chr(10) || chr(10) || b.text end) >= 900
  from fold f join blocks b on b.doc_id = f.doc_id and b.block = f.block + 1)
select doc_id, chunk::int chunk_id, arg_max(section, block) section, arg_max(subsection, block) subsection, arg_max(text, block) chunk
from fold group by doc_id, fold.chunk having length(arg_max(text, block)) >= 80""")
def packed_chunks(spark, d):
    return sections.chunks(table(spark, d, "documents"), ["doc_id"])


@query(SQL["section_blocks"])
def segmented_sections(spark, d):
    """``section_blocks`` by ranges of ten lines, the way of files that no row holds."""
    return segments.blocks(segments.lines_of(table(spark, d, "documents"), ["doc_id"]), ["doc_id"], 10)


@query(SQL["packed_chunks"])
def segmented_chunks(spark, d):
    return segments.chunks(segments.lines_of(table(spark, d, "documents"), ["doc_id"]), ["doc_id"], length=10)


@query(r"""select doc_id, (row_number() over (partition by doc_id order by s) - 1)::int window_id, piece from (
  select doc_id, s, regexp_replace(substr(text, s * 750 + 1, 900), '^[\s\v\x1c-\x1f\x{85}\x{a0}]+|[\s\v\x1c-\x1f\x{85}\x{a0}]+$', '', 'g') piece
  from documents, range(0, 100000) r(s) where s <= greatest(ceil((length(text) - 900) / 750.0), 0) and length(text) > 0) where piece != ''""")
def fixed_overlap_chunks(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.posexplode_outer(sections.fixed_windows(F.col("text"))).alias("window_id", "piece")).where("window_id is not null")


def _query_vector(spark, d) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_DENSE = """
qv as (select embedding::double[] q from embeddings where vec_id = 0),
dense as (select vec_id doc_id, round(list_sum(list_transform(list_zip(embedding::double[], q), lambda p: p[1] * p[2])), 5) score
          from embeddings, qv order by 2 desc, 1 limit 30)"""


@query(f"with {_DENSE} select doc_id vec_id, score from dense")
def dense_topk(spark, d):
    return retrieval.dense_top_k(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d))


_HYBRID = f"""{_BM25}, {_DENSE},
d as (select doc_id, case when max(score) over () = min(score) over () then 0.0 else (score - min(score) over ()) / (max(score) over () - min(score) over ()) end dense from dense),
s as (select doc_id, score / max(score) over () bm25 from sparse where score > 0),
mixed as (select doc_id, coalesce(dense, 0) dense, coalesce(bm25, 0) bm25, 0.65 * coalesce(dense, 0) + 0.35 * coalesce(bm25, 0) mix from d full join s using (doc_id))"""


def _candidates(spark, d):
    dense = retrieval.dense_top_k(table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", _query_vector(spark, d))
    return retrieval.hybrid(dense, bm25_topk(spark, d), "doc_id")


@query(f"with {_HYBRID} select doc_id, round(dense, 6) dense, round(bm25, 6) bm25, round(mix, 6) mix from mixed")
def hybrid_search(spark, d):
    return _candidates(spark, d).select("doc_id", *[F.round(c, 6).alias(c) for c in ("dense", "bm25", "mix")])


_GATED = f"""{_HYBRID},
joined as (select doc_id, source, text, round(mix, 6) mix from mixed join documents using (doc_id) where round(mix, 6) >= 0.15 and text != ''),
gated as (select * from (select *, row_number() over (partition by source order by mix desc, doc_id) t from joined) where t <= 2 order by mix desc, doc_id limit 8)"""


def _hits(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    # at most 60 candidates
    found = _candidates(spark, d).withColumn("mix", F.round("mix", 6))
    return retrieval.gated(docs.join(F.broadcast(found), "doc_id"), "doc_id", "source", "text")


@query(f"with {_GATED} select doc_id, source, mix from gated")
def gated_search(spark, d):
    return _hits(spark, d).select("doc_id", "source", "mix")


_CONTEXT = f"""{_GATED},
b as (select row_number() over (order by mix desc, doc_id) n, source, doc_id, mix, case when length(text) > 1600 then substr(text, 1, 1600) || ' ...' else text end body from gated),
c as (select n::int n, '[' || n || '] ' || source || ' | chunk ' || doc_id || ' | score=' || printf('%.3f', mix) || chr(10) || body || chr(10) block from b),
e as (select n, case when n = 1 then substr(block, 1, 8000) else block end block from c),
used as (select * from (select n, block, sum(length(block)) over (order by n)::bigint used from e) where used <= 8000)"""


def _context_blocks(spark, d):
    hits = _hits(spark, d).withColumn("_place", -F.col("mix")).withColumn("_order", F.struct("_place", "doc_id"))
    return retrieval.with_context(hits, "_order", "text", retrieval.context_label(F.col("source"), F.col("doc_id"), F.col("mix")))


@query(f"with {_CONTEXT} select * from used")
def context_budget(spark, d):
    return _context_blocks(spark, d).select("n", "block", "used")


PROMPT = "Answer from this alone:\n{context}\n\nQuestion: {question}"


@query(f"""with {_CONTEXT}, x as (select string_agg(block, chr(10) || chr(10) order by n) context from used)
select context, 'Answer from this alone:' || chr(10) || context || chr(10) || chr(10) || 'Question: what {{x}}?' prompt from x""")
def context_text(spark, d):
    one = retrieval.context(_context_blocks(spark, d))
    return one.select("context", retrieval.filled(PROMPT, F.col("context"), "what {x}?").alias("prompt"))


@query(r"""with a as (select conv_id, turn, list_transform(regexp_extract_all(text || ' [' || (turn + 1) || '] [1] [' || (conv_id % 9) || ']', '\[(\d+)\]', 1), lambda x: try_cast(x as bigint)) c from conversations),
u as (select conv_id, turn, c[i] n, i from a, range(1, 100000) r(i) where i <= len(c)),
k as (select conv_id, turn, n, min(i) i from u where n between 1 and 5 group by all)
select conv_id, turn, '[' || coalesce(string_agg((n - 1)::varchar, ', ' order by i), '') || ']' cited from a left join k using (conv_id, turn) group by 1, 2""")
def citations(spark, d):
    t = table(spark, d, "conversations")
    answer = F.concat("text", F.lit(" ["), F.col("turn") + 1, F.lit("] [1] ["), F.col("conv_id") % 9, F.lit("]"))
    return t.select("conv_id", "turn", F.concat(F.lit("["), F.array_join(X.cited(answer, F.lit(5)), ", "), F.lit("]")).alias("cited"))


@query(f"""with {_GATED},
h as (select doc_id, row_number() over (order by mix desc, doc_id) - 1 place, count(*) over () n from gated),
t as (select conv_id, turn, case when role = 'assistant' then [turn + 1, 1] else [] end c, (select count(*) from gated) n from conversations),
a as (select conv_id, turn, case when len(list_filter(c, lambda x: x <= n)) = 0 then range(0, least(5, n)) else list_transform(list_filter(c, lambda x: x <= n), lambda x: x - 1) end p from t),
x as (select conv_id, turn, p[i] place, i from a, range(1, 100) r(i) where i <= len(p))
select conv_id, turn, (row_number() over (partition by conv_id, turn order by i) - 1)::int as "rank", doc_id from (select conv_id, turn, place, min(i) i from x group by all) join h using (place)""")
def answer_sources(spark, d):
    hits = _hits(spark, d).select("doc_id", "mix")
    place = F.row_number().over(W.orderBy(F.desc("mix"), "doc_id")) - 1  # of a result list
    answer = F.when(F.col("role") == "assistant", F.concat(F.lit("by ["), F.col("turn") + 1, F.lit("] and [1], not [0] or [99]"))).otherwise("nothing")
    rows = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("k"), answer.alias("answer"))
    return retrieval.answer_sources(rows, "k", "answer", hits.withColumn("place", place).select("doc_id", "place"), "place").select("k.conv_id", "k.turn", "rank", "doc_id")


@query("select page_id, url from pages where url ilike '%/fr/%' or html ilike '%nation%'")
def like_search(spark, d):
    return inventory.like_search(table(spark, d, "pages"), "/fr/", ("url",)).select("page_id", "url").union(inventory.like_search(table(spark, d, "pages"), "nation", ("html",)).where(~F.col("url").ilike("%/fr/%")).select("page_id", "url"))


@query("""select 'documents' db_path, doc_id id, source name from documents where source ilike '%rc1%' or text ilike '%rc1%'
union all select 'pages', page_id, url from pages where url ilike '%rc1%' or html ilike '%rc1%'""")
def multi_db_union(spark, d):
    docs = table(spark, d, "documents").select(F.lit("documents").alias("db_path"), F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("content"))
    pages = table(spark, d, "pages").select(F.lit("pages").alias("db_path"), F.col("page_id").alias("id"), F.col("url").alias("name"), F.col("html").alias("content"))
    return inventory.like_search(docs.unionByName(pages), "rc1").drop("content")


@query(r"""with f as (select 'd/' || p_brand || '/' || p_name || case when p_size % 3 = 0 then '.PDF' when p_size % 3 = 1 then '.txt' else '' end path, p_size * 40000::bigint size from part),
e as (select *, case when path like '%.PDF' then '.pdf' when path like '%.txt' then '.txt' else '' end ext from f)
select regexp_extract(path, '([^/]*)$', 1) file_name, regexp_extract(path, '^(.*)/[^/]*$', 1) folder, ext, size, ext_files from (select *, count(*) over (partition by ext) ext_files from e)
where (ext = '.pdf' or ext = '.txt') and size / 1048576 between 0.5 and 1.5""")
def inventory_list(spark, d):
    ext = F.when(F.col("p_size") % 3 == 0, ".PDF").when(F.col("p_size") % 3 == 1, ".txt").otherwise("")
    files = table(spark, d, "part").select(F.concat(F.lit("d/"), "p_brand", F.lit("/"), "p_name", ext).alias("path"), (F.col("p_size") * 40000).cast("long").alias("size"))
    return inventory.inventory_list(files, "path", "size", (".pdf", ".txt"), 0.5, 1.5).select("file_name", "folder", "ext", "size", "ext_files")


@query("select p_name || '.pdf' as \"name\", '/a b/' || p_name || '.pdf' path from part where p_size > 25")
def copied_lists(spark, d):
    return inventory.copied_lists(table(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("/a b/"), "p_name", F.lit(".pdf")).alias("path")), "path")


@query("select doc_id, n_chars from documents where n_chars / 1048576 between 0.002 and 0.01")
def size_filter(spark, d):
    return inventory.in_size_range(table(spark, d, "documents"), "n_chars", 0.002, 0.01).select("doc_id", "n_chars")


@query("select case when p_size % 3 = 0 then '.pdf' when p_size % 3 = 1 then '.txt' else '' end ext, count(*) n from part group by 1")
def ext_facets(spark, d):
    name = F.concat(F.lit("/a.b/"), F.col("p_partkey"), F.when(F.col("p_size") % 3 == 0, ".PDF").when(F.col("p_size") % 3 == 1, ".x.txt").otherwise(""))
    return inventory.extension_facets(table(spark, d, "part").select(name.alias("path")), "path")


@query("""select 'f' || p_partkey || '.PDF' file_name, strftime(o_orderdate, '%Y-%m-%d %H:%M') date_modified, 'PDF' as "type",
printf('%.2f', p_size / 8.0) size_mb, '/r/f' || p_partkey || '.PDF' path from part join orders on o_orderkey = p_partkey""")
def file_listing(spark, d):
    joined = table(spark, d, "part").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("p_partkey"))
    rows = joined.select(F.concat(F.lit("/r/f"), F.col("p_partkey"), F.lit(".PDF")).alias("path"), (F.col("p_size").cast("long") * 131072).alias("size"), F.col("o_orderdate").alias("mtime"))
    return inventory.listing(rows, "path", "size", "mtime")


@query("select 'd/' || p_name path, 'd/x_' || replace(p_name, 'red ', '') || '_y' new_path from part")
def rename_plan(spark, d):
    return inventory.rename_plan(table(spark, d, "part").select(F.concat(F.lit("d/"), F.col("p_name")).alias("path")), "path", "x_", "_y", "red ")


@query("select doc_id from documents where doc_id % 3 != 0")
def manifest_delta(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/f/"), F.col("doc_id")).alias("path"), F.col("doc_id").alias("mtime"), F.col("n_chars").alias("size"))
    return dedup.new_files(files, files.where("doc_id % 3 = 0").select("path", "mtime", "size")).select("doc_id")


@query("select p_partkey, 'item' || lpad(p_partkey::varchar, 20, '0') || 'x' || lpad(p_size::varchar, 20, '0') natural_key from part")
def natural_sort_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", X.natural_key(F.concat(F.lit("Item0"), F.col("p_partkey"), F.lit("X"), F.col("p_size"))).alias("natural_key"))


@query("select p_partkey, sha1(lower(p_name)) h from part")
def folded_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", X.text_sha1(F.concat(F.lit(" \t"), F.col("p_name"), F.lit("\n"))).alias("h"))


@query("""select doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) line from documents)
where regexp_matches(line, '^\\s*(\\d+(\\.\\d+)*)\\s*[.)-]?\\s+(.+)$') or (regexp_matches(line, '\\p{Lu}') and not regexp_matches(line, '[\\p{Ll}\\p{Lt}]') and length(line) between 6 and 120)""")
def headings(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(X.is_heading(F.col("line")))


@query(r"""select page_id, replace(replace(replace(replace(replace(replace(array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script[^>]*>.*?</script>', '<x>', 'g'), '(?is)<style[^>]*>.*?</style>', '<x>', 'g'), '(?s)<!--.*?-->', '<x>', 'g'), '<[/!a-zA-Z][^>]*>'), lambda x: x != ''), chr(10)),
  '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') text from pages""")
def html_pages_text(spark, d):
    @F.pandas_udf("string")
    def visible(pages):
        return pages.map(html_text, na_action="ignore")

    return table(spark, d, "pages").select("page_id", visible("html").alias("text"))


_CONTAINERS = """
raw as (select conv_id, 'c' || conv_id container, turn, '/x/' || conv_id || '/' || turn || '.pdf' path, text note from conversations),
old as (select container, (row_number() over (partition by container order by turn) - 1)::int pos, path, note from raw)"""


def _entries(spark, d):
    """Conversations as containers: each turn is a noted file, kept as JSON lists in the way containers are saved."""
    t = table(spark, d, "conversations")
    note = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("text")))).otherwise(F.col("text"))
    entry = F.struct("turn", F.concat(F.lit("/x/"), "conv_id", F.lit("/"), "turn", F.lit(".pdf")).alias("path"), note.alias("note"))
    lists = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.array(e["path"], e["note"])).alias("l"))
    raw = lists.select(F.to_json(F.create_map(F.concat(F.lit("c"), "conv_id"), F.col("l"))).alias("j"))
    return inventory.containers_table(raw, "j")


@query(f"""with {_CONTAINERS},
more as (select container, '/z' path, 'n' note from old where pos = 0 union all select container, path, 'again' from old where pos = 0 union all select 'new', '/n', ''),
added as (select * from more m where not exists (from old o where o.container = m.container and o.path = m.path)),
every as (select * from old union all select a.container, coalesce((select max(pos) + 1 from old o where o.container = a.container), 0)::int, path, note from added a)
select container, pos, path, case when container = 'c1' and path = '/x/1/0.pdf' then 'mine' else note end note from every""")
def container_notes(spark, d):
    rows = _entries(spark, d)
    first = rows.where("pos = 0").select("container", "path")
    more = first.select("container", F.lit("/z").alias("path"), F.lit("n").alias("note")).union(first.withColumn("note", F.lit("again"))).union(spark.createDataFrame([("new", "/n", "")], "container string, path string, note string"))
    return inventory.save_note(inventory.add_entries(rows, more), "c1", "/x/1/0.pdf", "mine")


@query(f"""with {_CONTAINERS}, kept as (select * from old where container != 'c2' and not (container = 'c1' and pos = (select min(pos) from old where container = 'c1' and path like '%/1.pdf')))
select container, pos, path, note from kept where contains(container, '1')""")
def container_filter(spark, d):
    rows = inventory.delete_first(inventory.delete_container(_entries(spark, d), "c2"), "c1", "1.pdf")
    return inventory.filter_containers(rows, "C").where(F.col("container").contains("1"))


@query("select container from (select distinct 'c' || conv_id container from conversations union select 'b' || user_id from events) where container != 'c3'")
def container_names(spark, d):
    names = table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("container")).distinct()
    users = table(spark, d, "events").select(F.concat(F.lit("b"), "user_id").alias("container"))
    return inventory.delete_container(inventory.create_containers(names, users.union(names)), "c3")


@query(f"""with {_CONTAINERS} select container, count(*) n, count(*) filter (where note is not null) noted from old group by 1 union all select 'empty', 0, 0""")
def container_save(spark, d):
    entries = _entries(spark, d)
    names = inventory.create_containers(entries.select("container").distinct(), spark.createDataFrame([("empty",)], "container string"))
    saved = inventory.containers_json(names, entries)
    back = inventory.containers_table(saved.select(F.concat(F.lit("{\""), "container", F.lit("\":"), "entries", F.lit("}")).alias("j")), "j")
    counts = back.groupBy("container").agg(F.count("*").alias("n"), F.count("note").alias("noted"))
    return saved.select("container").join(counts, "container", "left").na.fill(0)


@query("""select p_partkey, 'file' || lpad(p_partkey::varchar, 20, '0') || 'x.pdf' name_key, epoch(o_orderdate)::bigint date_key, 'pdf' type_key, p_size * 1024::bigint size_key, '/r/file' || p_partkey || 'x.pdf' path_key
from part join orders on o_orderkey = p_partkey""")
def typed_sort_keys(spark, d):
    joined = table(spark, d, "part").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("p_partkey"))
    rows = joined.select("p_partkey", F.concat(F.lit("/R/File"), "p_partkey", F.lit("X.PDF")).alias("path"), (F.col("p_size").cast("long") * 1024).alias("size"), F.col("o_orderdate").alias("mtime"))
    return inventory.sort_keys(rows, "path", "size", "mtime").drop("path", "size", "mtime")


@query("""select '/a "b"/' || p_name || '.pdf' path, p_name || '.pdf' || chr(9) || '/a "b"' tsv, '=HYPERLINK("/a ""b""/' || p_name || '.pdf","Open File")' formula from part""")
def export_lines(spark, d):
    return inventory.export_lines(table(spark, d, "part").select(F.concat(F.lit('/a "b"/'), "p_name", F.lit(".pdf")).alias("path")), "path")


_TYPED = "case when doc_id % 3 = 0 then '.PDF' when doc_id % 3 = 1 then '.docx' else '.txt' end"


@query(f"select doc_id from documents where {_TYPED} in ('.PDF', '.docx') and contains(lower(text), 'the')")
def content_search(spark, d):
    ext = F.when(F.col("doc_id") % 3 == 0, ".PDF").when(F.col("doc_id") % 3 == 1, ".docx").otherwise(".txt")
    return inventory.content_search(table(spark, d, "documents").select("doc_id", F.concat(F.lit("/f/"), "doc_id", ext).alias("path"), "text"), "The").select("doc_id")


@query(f"select doc_id, {_TYPED} = '.docx' exact, {_TYPED} = '.PDF' folded from documents where {_TYPED} != '.txt'")
def ext_filter(spark, d):
    ext = F.when(F.col("doc_id") % 3 == 0, ".PDF").when(F.col("doc_id") % 3 == 1, ".docx").otherwise(".txt")
    files = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/f/"), "doc_id", ext).alias("path"))
    one = inventory.with_extension(files, "path", ".docx").select("doc_id", F.lit(True).alias("exact"), F.lit(False).alias("folded"))
    none = inventory.with_extension(files, "path", ".pdf")  # the facet is lower-cased, the paths are not
    return one.union(none.select("doc_id", F.lit(True), F.lit(True))).union(inventory.with_extension(files, "path", ".pdf", any_case=True).select("doc_id", F.lit(False), F.lit(True)))


@query("""select p_partkey, 'plain' how from part where contains(lower(p_name), 'ring') union all
select p_partkey, 'star' from part where regexp_matches(p_name, 'ring.*small|small.*ring', 'i') union all
select p_partkey, 'fuzzy' from part where contains(lower(p_name), 'ring') and contains(lower(p_name), 'small') union all
select p_partkey, 'literal' from part where contains(lower(p_name), 'ring*')""")
def query_router(spark, d):
    rows, c = table(spark, d, "part"), F.col("p_name")
    found = [rows.where(names.route(q, c, threshold=100.0)).select("p_partkey", F.lit(how).alias("how")) for how, q in (("plain", " Ring "), ("star", "small*RING"), ("fuzzy", "@Ring SMALL"), ("literal", "@ring*"))]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query("""select trim(p_name) as "key", trim(p_brand) || '|' || trim(p_type) || '|' synonyms from part where p_size % 2 = 0""")
def synonym_table(spark, d):
    rows = table(spark, d, "part")
    line = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, F.lit(" == ")).otherwise(" = "), "p_brand", F.lit(" , "), "p_type", F.lit(","))
    return names.synonym_table(rows.select(line.alias("line")), "line").select("key", F.array_join("synonyms", "|").alias("synonyms"))


@query("""select 's' || p_partkey as "name", p_size % 3 != 0 valid from part""")
def store_catalog(spark, d):
    at = F.concat(F.lit("s"), "p_partkey", F.lit("/"))
    rows = table(spark, d, "part").select(F.explode(F.when(F.col("p_size") % 3 != 0, F.array(F.concat(at, F.lit("chunks/part-0")), F.concat(at, F.lit("config/part-0")))).otherwise(F.array(F.concat(at, F.lit("chunks/part-0"))))).alias("path"))
    return store.catalog(rows, "path")


_PIECES = r"""pieces as (select doc_id, (row_number() over (partition by doc_id order by s) - 1)::int chunk_id, piece, lang, source, n_chars from (
  select doc_id, lang, source, n_chars, s, regexp_replace(substr(text, s * 750 + 1, 900), '^[\s\v\x1c-\x1f\x{85}\x{a0}]+|[\s\v\x1c-\x1f\x{85}\x{a0}]+$', '', 'g') piece
  from documents, range(0, 100000) r(s) where s <= greatest(ceil((length(text) - 900) / 750.0), 0) and length(text) > 0) where piece != '')"""


@query(f"""with {_PIECES}, f as (select 'd' || doc_id || '.MD' file_name, lang || '/' || source || '/d' || doc_id || '.MD' rel_path, chunk_id, length(piece)::int chunk_len, n_chars // 1024 size_kb from pieces)
select row_number() over (order by rel_path, chunk_id) + 6 id, file_name, rel_path, 'lib' source_folder, 'md' file_type, chunk_id, chunk_len, size_kb from f""")
def chunk_metadata(spark, d):
    docs = table(spark, d, "documents").withColumn("path", F.concat(F.lit("/srv/lib/"), "lang", F.lit("/"), "source", F.lit("/d"), "doc_id", F.lit(".MD")))
    cut = docs.select("path", "n_chars", F.posexplode_outer(sections.fixed_windows(F.col("text"))).alias("chunk_id", "piece")).where("chunk_id is not null")
    root = metadata.common_root(docs, "path").first()[0]  # one row
    rows = metadata.with_source(cut.withColumn("chunk_len", F.length("piece")).drop("piece"), "path", "n_chars", root)
    return metadata.with_running_id(rows, ["rel_path", "chunk_id"], scratch(spark, "ids"), first=7).select("id", "file_name", "rel_path", "source_folder", "file_type", "chunk_id", "chunk_len", "size_kb")


@query("select lower(case when doc_id % 4 = 0 then 'd' || doc_id % 50 || '.txt' else 'F' || doc_id % 20 end) as \"name\", count(*) n from documents group by 1")
def name_counter(spark, d):
    rows = table(spark, d, "documents").select(F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("F"), F.col("doc_id") % 20)).otherwise("").alias("file_name"), F.concat(F.lit("/a/D"), F.col("doc_id") % 50, F.lit(".TXT")).alias("path"))
    return dedup.name_counts(rows, "file_name", "path")


@query("select p_partkey, contains(lower(p_name), 'small') as \"known\" from part")
def known_names(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.initcap("p_name").alias("p_name"))
    some = table(spark, d, "part").where(F.lower("p_name").contains("small")).select("p_name", F.lit("/").alias("path"))
    return dedup.with_known_name(rows, dedup.name_counts(some, "p_name", "path"), "p_name").select("p_partkey", "known")


@query("select max(doc_id) + 1 next_id from documents where doc_id % 2 = 0")
def next_chunk_id(spark, d):
    return dedup.next_id(table(spark, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("x"), "doc_id")).alias("id")), "id")


@query(f"""with h as (select sha1({_FOLD}) h, {_FOLD} = '' blank from documents)
select count(distinct h) filter (where not blank) n_unique, count(*) filter (where not blank) - count(distinct h) filter (where not blank) n_dup,
round((count(*) filter (where not blank) - count(distinct h) filter (where not blank)) / count(*), 6) ratio from h""")
def dup_summary(spark, d):
    return dedup.duplicate_summary(table(spark, d, "documents"), "text", ["doc_id"])


@query(f"""with h as (select doc_id, sha1({_FOLD}) h, {_FOLD} = '' blank from documents)
select h chunk_hash, min(doc_id) doc_id from h where not blank and h not in (select h from h where doc_id % 3 = 0 and not blank) group by 1""")
def append_new_chunks(spark, d):
    docs = table(spark, d, "documents")
    known = docs.where("doc_id % 3 = 0").select(X.text_sha1(F.col("text")).alias("chunk_hash"))
    return dedup.first_seen(docs, "text", ["doc_id"], known)


_RERANKED = """p as (select *, row_number() over (order by mix desc, doc_id) place from {0}),
r as (select *, case when place <= 40 and text != '' then (length(text) % 97)::double end raw from p),
n as (select *, case when raw is null then null when max(raw) over () = min(raw) over () then 0.0 else (raw - min(raw) over ()) / (max(raw) over () - min(raw) over ()) end rerank from r),
f as (select *, round(coalesce(0.7 * rerank + 0.3 * mix, mix), 8) final from n)"""


def _model(texts):
    """Stands for a cross-encoder, which is not at hand."""
    return (texts.str.len() % 97).astype("float64")


@query(f"""with {_HYBRID}, j as (select doc_id, text, round(mix, 6) mix from mixed join documents using (doc_id)), {_RERANKED.format('j')}
select doc_id, mix, round(rerank, 6) rerank, final from f""")
def rerank_mix(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = docs.join(F.broadcast(_candidates(spark, d).withColumn("mix", F.round("mix", 6))), "doc_id")  # at most 60 candidates
    return retrieval.rerank(found, "doc_id", "text", _model).select("doc_id", "mix", F.round("rerank", 6).alias("rerank"), F.round("final", 8).alias("final"))


_STORED = _HYBRID.replace("from documents", "from stored").replace("from embeddings, qv", "from embeddings, qv where vec_id in (select doc_id from stored)")


def _stored(spark, d):
    """Documents that have a vector; the others go before anything is shuffled or hashed."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("chunk"))
    return membership.with_key_of(rows, "id", vectors).join(vectors, "id").withColumn("chunk_hash", X.text_sha1(F.col("chunk")))


@query(f"""with stored as (select doc_id, source, text from documents where doc_id in (select vec_id from embeddings)), {_STORED},
j as (select doc_id, source, text, round(mix, 6) mix from mixed join stored using (doc_id)), {_RERANKED.format('j')},
t as (select *, row_number() over (partition by source order by final desc, doc_id) turn from f where final >= 0.15 and text != '')
select doc_id, source, final from t where turn <= 2 order by final desc, doc_id limit 8""")
def store_search(spark, d):
    chunks = _stored(spark, d)
    at, config = scratch(spark, "store"), store.StoreConfig(model_name="given", dim=64)
    state = versions.snapshot(spark, at)
    for i in range(3):  # a build and two appends
        state = store.add_chunks(chunks.where(F.pmod("id", F.lit(3)) == i), at, state, f"b{i}", config)
    spark.createDataFrame([asdict(config)]).write.parquet(f"{at}/config")
    return store.search(spark, at, QUERY, _query_vector(spark, d), "source", _model).select(F.col("id").alias("doc_id"), "source", "final")


@query(f"with {_BM25} select * from sparse where score > 0")
def store_bm25_topk(spark, d):
    """Postings of a build and two appends, whose statistics add up."""
    docs, at, stats = table(spark, d, "documents"), scratch(spark, "postings"), postings.Statistics(0, 0)
    for i in range(3):
        stats += postings.write(docs.where(F.col("doc_id") % 3 == i), "doc_id", "text", f"{at}/batch={i}")
    return postings.top_k(spark.read.parquet(at), stats, QUERY, 30).select(F.col("key").alias("doc_id"), "score")


def _vector_index(spark, d):
    vectors, at = table(spark, d, "embeddings"), scratch(spark, "ivf")
    centres = ivf.centroids(vectors, "vec_id", "embedding", 64)
    ivf.write(vectors, "vec_id", "embedding", centres, at)
    return spark.read.parquet(at), centres


@query(f"with {_DENSE} select doc_id vec_id, score from dense")
def ivf_exact_topk(spark, d):
    index, centres = _vector_index(spark, d)
    return ivf.top_k(index, centres, _query_vector(spark, d), 30, probes=None).withColumnRenamed("key", "vec_id")


@query()
def ivf_topk(spark, d):
    """The approximate search; its recall is measured in tests/test_ivf.py."""
    index, centres = _vector_index(spark, d)
    return ivf.top_k(index, centres, _query_vector(spark, d), 30, ivf.probes_for(index, centres)).withColumnRenamed("key", "vec_id")


@query(SQL["append_new_chunks"])
def append_filtered_chunks(spark, d):
    """``append_new_chunks`` with a filter of the store's hashes asked first."""
    docs = table(spark, d, "documents").withColumn("chunk_hash", X.text_sha1(F.col("text")))
    known = docs.where("doc_id % 3 = 0").select("chunk_hash")
    at = scratch(spark, "filters")
    membership.filter_of(known, "chunk_hash", known.count()).write.parquet(at)
    some = membership.known_among(docs, "chunk_hash", known, spark.read.parquet(at))
    return dedup.first_seen(docs.drop("chunk_hash"), "text", ["doc_id"], some)
