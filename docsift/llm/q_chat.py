"""op1: conversations 2k (chosen) and 2k+1 (rejected) as preference pairs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm._spark import table
from docsift.llm.chat import preference_parts, preference_turns

_SIDE = """coalesce(string_agg(rendered, '' order by pos) filter (where part = '{0}'), '') {0},
       coalesce(string_agg((begins + 13 + length(role)) || ':' || (begins + 23 + length(role) + length(text)), ',' order by pos) filter (where part = '{0}' and role = 'assistant'), '') {0}_mask"""
SQL = f"""
with t as (select conv_id // 2 pair_id, case when conv_id % 2 = 0 then 'chosen' else 'rejected' end side,
                  coalesce(role, 'unknown') role, coalesce(text, '') text, coalesce(turn, 9223372036854775807) k
           from conversations where conv_id is not null),
d as (select *, dense_rank() over (partition by pair_id, side order by k) place from t),
bags as (select pair_id, place, role, text, count(*) filter (where side = 'chosen') c, count(*) filter (where side = 'rejected') r
         from d group by all),
cut as (select pair_id, min(place) cut_at from bags where c != r group by 1),
p as (select d.*, (cut_at is null or place < cut_at) shared, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) rendered from d left join cut using (pair_id)),
q as (select *, case when shared then 'prompt' else side end part, row_number() over (partition by pair_id, side, shared order by k, role, text) - 1 pos
      from p where not (shared and side = 'rejected')),
z as (select *, pos // 256 part_no, sum(length(rendered)) over (partition by pair_id, part, pos // 256 order by pos) - length(rendered) begins from q)
select pair_id, part_no, coalesce(string_agg(rendered, '' order by pos) filter (where part = 'prompt'), '') prompt,
       {_SIDE.format('chosen')},
       {_SIDE.format('rejected')}
from z group by pair_id, part_no
"""


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    # the table holds no verdicts: neighbours by number stand for the two answers of a comparison
    sides = turns.withColumns({"pair_id": F.shiftright("conv_id", 1), "side": F.when(F.col("conv_id") % 2 == 0, "chosen").otherwise("rejected")})
    pairs = preference_parts(preference_turns(sides))
    spans = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",").alias(c)
    return pairs.select("pair_id", "part_no", "prompt", "chosen", spans("chosen_mask"), "rejected", spans("rejected_mask"))
