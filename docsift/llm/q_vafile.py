"""op9: the ten highest inner products of every hundredth vector."""

from pyspark.sql import DataFrame, SparkSession

from docsift.llm._spark import table
from docsift.llm.vafile import top_k

SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) q from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint score
      from v a join v b on a.vec_id % 100 = 0 and b.vec_id != a.vec_id and len(a.q) = len(b.q))
select query_id, rank::int rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 10
"""


def op9_va_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where("vec_id % 100 = 0"), vectors, 10)
