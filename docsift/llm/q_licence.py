"""op4: licences of documents, laid out as a tree of files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm._spark import table
from docsift.llm.licence import ANCHOR, IDENTIFIERS, NO_PASSAGE, RAREST, TAG, TEMPLATES, THRESHOLD, scan_licences


def with_paths(docs: DataFrame) -> DataFrame:
    """Documents have no paths: a source is a repository, a thousand ids a folder, ten ids a folder in it.

    Each tenth document takes the place of its folder's licence file, each hundredth that of the folder above.
    """
    i = F.col("doc_id")
    upper = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(i / 1000).cast("string"))
    lower = F.concat_ws("/", upper, F.floor(i / 10).cast("string"))
    name = F.when(i % 100 == 0, F.concat(upper, F.lit("/LICENSE-"), i)).when(i % 10 == 0, F.concat(lower, F.lit("/LICENSE-"), i)).otherwise(F.concat(lower, F.lit("/"), i, F.lit(".txt")))
    return docs.withColumn("path", name)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(with_paths(table(spark, sf_dir, "documents")), key="doc_id")


_ROWS = ", ".join("('{0}', '{0} {1}', '{2}')".format(name, i, line.replace("'", "''")) for name, lines in TEMPLATES.items() for i, line in enumerate(lines))
_IDS = ", ".join(f"('{i}', '{name}')" for i, name in sorted(IDENTIFIERS.items()))
_TERMS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
SQL = f"""
with tpl(licence, template, line) as (values {_ROWS}),
tt as (select licence, template, term, count(*) tf from (select licence, template, unnest({_TERMS.format('line')}) term from tpl) group by all),
n as (select count(*) n from documents),
df as (select term, count(*) df from (select unnest(list_distinct({_TERMS.format('text')})) term from documents) where term in (select term from tt) group by 1),
idf as (select term, ln(least({RAREST}, (1.0 + n) / (1.0 + coalesce(df, 0)))) + 1 idf from (select distinct term from tt) left join df using (term), n),
w as (select licence, template, term, tf * idf w from tt join idf using (term)),
norms as (select template, sqrt(sum(w * w)) norm from w group by 1),
split as (select doc_id, string_split_regex(text, '\\r?\\n') l from documents where regexp_matches(text, '{ANCHOR}')),
anchored as (select doc_id, i - 1 line, l[i] one, array_to_string(list_slice(l, greatest(i - 1, 1), greatest(i - 1, 1) + 2), ' ') three
             from (select doc_id, l, unnest(range(1, len(l) + 1)) i from split) where regexp_matches(l[i], '{ANCHOR}')),
every_passage as (select doc_id, line, 1 k, one passage from anchored union all select doc_id, greatest(line - 1, 0), 3, three from anchored
             union all select doc_id, 0, 0, text from documents where regexp_matches(text, '{ANCHOR}')),
passages as (select * from every_passage where not regexp_matches(passage, '{NO_PASSAGE}')),
ids(id, licence) as (values {_IDS}),
tags as (select doc_id, first(licence order by line) licence, min(line) line from (select doc_id, i - 1 line, regexp_extract(lower(l[i]), '{TAG}', 1) id from (select doc_id, l, unnest(range(1, len(l) + 1)) i from split)) join ids using (id) group by 1),
tf as (select doc_id, line, k, term, count(*) tf from (select doc_id, line, k, unnest({_TERMS.format('passage')}) term from passages) group by all),
u as (select doc_id, line, k, term, tf * coalesce(idf, ln(least({RAREST}, 1.0 + n)) + 1) u from tf left join idf using (term), n),
lengths as (select doc_id, line, k, sqrt(sum(u * u)) length from u group by all),
cosines as (select doc_id, licence, line, round(sum(u * w) / any_value(norm) / any_value(length), 6) similarity
            from u join w using (term) join norms using (template) join lengths using (doc_id, line, k) group by doc_id, licence, line, k, template),
closest as (select doc_id, first(licence order by similarity desc, licence, line) own_licence, max(similarity) similarity, first(line order by similarity desc, licence, line)::int line
        from cosines where similarity >= {THRESHOLD} group by doc_id),
own as (select doc_id, licence own_licence, 1.0::double similarity, line::int line from tags union all select * from closest where doc_id not in (select doc_id from tags)),
placed as (select doc_id, coalesce(source, 'none') || '/' || doc_id // 1000 upper_dir, upper_dir || '/' || doc_id // 10 lower_dir from documents),
files as (select doc_id, case when doc_id % 100 = 0 then upper_dir else lower_dir end dir, case when doc_id % 10 = 0 then '/LICENSE-' || doc_id else '/' || doc_id || '.txt' end name from placed),
holders as (select dir, first(own_licence order by similarity desc, own_licence) held from files join own using (doc_id) where name like '/LICENSE%' group by 1)
select f.doc_id, f.dir || f.name path, own_licence, similarity, line, coalesce(own_licence, a.held, b.held) licence,
       case when own_licence is null then case when a.held is not null then f.dir when b.held is not null then parent end end inherited_from
from (select *, regexp_replace(dir, '/[^/]*$', '') parent from files) f left join own using (doc_id)
left join holders a on a.dir = f.dir left join holders b on b.dir = f.parent
"""
