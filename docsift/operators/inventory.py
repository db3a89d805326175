"""File inventories, rename plans and containers of noted files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import extension, file_name, file_type, natural_key, size_mb


def listing(files: DataFrame, path: str, size: str, mtime: str) -> DataFrame:
    """The five result columns of a file list."""
    return files.select(file_name(F.col(path)).alias("file_name"), F.date_format(mtime, "yyyy-MM-dd HH:mm").alias("date_modified"), file_type(F.col(path)).alias("type"), size_mb(F.col(size)).alias("size_mb"), F.col(path).alias("path"))


def sort_keys(files: DataFrame, path: str, size: str, mtime: str) -> DataFrame:
    """``files`` with a typed key for each column of a listing: names in natural order, dates and sizes as numbers."""
    return files.withColumns({
        "name_key": natural_key(file_name(F.col(path))),
        "date_key": F.col(mtime).cast("timestamp").cast("long"),
        "type_key": F.lower(file_type(F.col(path))),
        "size_key": F.col(size).cast("long"),
        "path_key": F.lower(path),
    })


def sorted_listing(files: DataFrame, path: str, size: str, mtime: str, by: str = "name", descending: bool = False) -> DataFrame:
    """The listing's columns, sorted by one of name, date, type, size and path; ties by path."""
    key = F.col(f"{by}_key")
    keyed = sort_keys(files, path, size, mtime).orderBy(key.desc() if descending else key.asc(), path)
    return listing(keyed, path, size, mtime)


def export_lines(files: DataFrame, path: str) -> DataFrame:
    """tsv (file name and folder) and formula (a spreadsheet link) of each file."""
    name = file_name(F.col(path))
    folder = F.rtrim(F.substr(F.col(path), F.lit(1), F.length(path) - F.length(name)), F.lit("/"))
    link = F.concat(F.lit('=HYPERLINK("'), F.replace(F.col(path), F.lit('"'), F.lit('""')), F.lit('","Open File")'))
    return files.select(F.col(path).alias("path"), F.concat_ws("\t", name, folder).alias("tsv"), link.alias("formula"))


def copied_lists(files: DataFrame, path: str) -> DataFrame:
    """name and path of some files, the two lists that ``write_lines`` copies, in order of paths."""
    return files.select(file_name(F.col(path)).alias("name"), F.col(path).alias("path")).orderBy("path")


def write_lines(lines: DataFrame, column: str, to: str) -> None:
    """A list for copying: one line for each row."""
    lines.select(column).write.text(to)


def content_search(files: DataFrame, keyword: str, extensions: tuple[str, ...] = (".pdf", ".docx")) -> DataFrame:
    """Files (path, text) of some kinds whose text contains the keyword, ignoring case."""
    return files.where(extension(F.col("path")).isin(*extensions) & F.coalesce(F.lower("text").contains(keyword.lower()), F.lit(False)))


def extension_facets(files: DataFrame, path: str) -> DataFrame:
    """ext, n, in order of extensions."""
    return files.groupBy(extension(F.col(path)).alias("ext")).agg(F.count("*").alias("n")).orderBy("ext")


def with_extension(files: DataFrame, path: str, ext: str, any_case: bool = False) -> DataFrame:
    """Files whose path ends in ``ext``; the facet is lower-cased, the path is not unless ``any_case``."""
    return files.where((F.lower(path) if any_case else F.col(path)).endswith(ext))


def in_size_range(files: DataFrame, size: str, low_mb: float = 0.0, high_mb: float = float("inf")) -> DataFrame:
    return files.where((F.col(size) / 1048576).between(low_mb, high_mb))


def inventory_list(files: DataFrame, path: str, size: str, kinds: tuple[str, ...] | None = None, low_mb: float = 0.0, high_mb: float = float("inf")) -> DataFrame:
    """file_name, folder, ext, size, size_mb, path of files of some kinds (lower-cased extensions) and sizes, in natural order of paths.

    ``ext_files`` is the facet: how many files of its extension the whole list has, before the filter on sizes
    and kinds.  A size that is not known is null, and in the list as long as no range is asked for.
    """
    rows = files.select(F.col(path).alias("path"), F.col(size).cast("long").alias("size")).withColumn("ext", extension(F.col("path")))
    facets = rows.groupBy(F.col("ext").alias("_ext")).agg(F.count("*").alias("ext_files"))
    some = rows.where(F.col("ext").isin(*kinds)) if kinds else rows
    if (low_mb, high_mb) != (0.0, float("inf")):
        some = in_size_range(some, "size", low_mb, high_mb)
    name = file_name(F.col("path"))
    folder = F.rtrim(F.substr(F.col("path"), F.lit(1), F.length("path") - F.length(name)), F.lit("/"))
    listed = some.join(facets, F.col("ext") == F.col("_ext"))
    return listed.select(name.alias("file_name"), folder.alias("folder"), "ext", "size", size_mb(F.col("size")).alias("size_mb"), "path", "ext_files").orderBy(natural_key(F.col("path")), "path")


def rename_plan(files: DataFrame, path: str, prefix: str = "", suffix: str = "", remove: str = "") -> DataFrame:
    """path, new_path: what a batch rename would do.  The suffix comes after the extension, as typed."""
    name = file_name(F.col(path))
    kept = F.replace(name, F.lit(remove), F.lit("")) if remove else name
    folder = F.substr(F.col(path), F.lit(1), F.length(path) - F.length(name))
    return files.select(F.col(path).alias("path"), F.concat(folder, F.lit(prefix), kept, F.lit(suffix)).alias("new_path"))


def containers_table(raw: DataFrame, json_column: str) -> DataFrame:
    """container, pos, path, note from a JSON map of [path, note] lists; plain notes and {"text": ...} alike."""
    lists = raw.select(F.explode(F.from_json(json_column, "map<string,array<array<string>>>")).alias("container", "entries"))
    entries = lists.select("container", F.posexplode("entries").alias("pos", "e"))
    note = F.get("e", 1)
    return entries.select("container", "pos", F.get("e", 0).alias("path"), F.when(note.startswith("{"), F.get_json_object(note, "$.text")).otherwise(note).alias("note"))


def add_entries(table: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Entries (container, path, note) whose path its container lacks go to the end.

    Of entries that name a path twice the first by ``order``, a column of ``new``, is added, and those added stand in
    that order; without one, the least note is, and they stand in order of paths.
    """
    first = F.min(F.struct(F.col(order or "note").alias("_by"), F.col("note").alias("note")))
    fresh = new.join(table.select("container", "path"), ["container", "path"], "left_anti").groupBy("container", "path").agg(first.alias("_f")).select("container", "path", "_f.*")
    ends = table.groupBy("container").agg(F.max("pos").alias("_end"))
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("container").orderBy(*(["_by"] if order else []), "path"))
    added = fresh.withColumn("_n", place).join(ends, "container", "left")
    return table.select("container", "pos", "path", "note").unionByName(added.select("container", (F.coalesce("_end", F.lit(-1)) + F.col("_n")).cast("int").alias("pos"), "path", "note"))


def create_containers(names: DataFrame, new: DataFrame) -> DataFrame:
    """Container names with those of ``new`` that are not taken."""
    return names.select("container").union(new.select("container").where("container is not null").distinct().join(names.select("container"), "container", "left_anti"))


def delete_container(table: DataFrame, container: str) -> DataFrame:
    """Names or entries without those of one container."""
    return table.where(F.col("container") != container)


def filter_containers(table: DataFrame, text: str) -> DataFrame:
    return table.where(F.lower("container").contains(text.lower()))


def containers_json(names: DataFrame, entries: DataFrame) -> DataFrame:
    """container, entries: its list of [path, note] as JSON, in order; a container without entries has an empty one.

    A container is a user's list of files, so it fits in a row.
    """
    note = F.to_json(F.struct(F.coalesce("note", F.lit("")).alias("text")))
    lists = entries.groupBy("container").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path", note.alias("note")))), lambda e: F.array(e["path"], e["note"])).alias("l"))
    return names.select("container").join(lists, "container", "left").select("container", F.coalesce(F.to_json("l"), F.lit("[]")).alias("entries"))


def delete_first(table: DataFrame, container: str, name: str) -> DataFrame:
    """Without the container's first entry of that file name."""
    hit = table.where((F.col("container") == container) & (file_name(F.col("path")) == name)).agg(F.min("pos").alias("_gone"))
    return table.join(F.broadcast(hit), (F.col("container") == container) & (F.col("pos") == F.col("_gone")), "left_anti")


def save_note(table: DataFrame, container: str, path: str, note: str) -> DataFrame:
    """The container's first entry of that path gets the note."""
    hit = table.where((F.col("container") == container) & (F.col("path") == path)).agg(F.min("pos").alias("_at"))
    out = table.join(F.broadcast(hit), (F.col("container") == container) & (F.col("pos") == F.col("_at")), "left")
    return out.withColumn("note", F.when(F.col("_at").isNotNull(), note).otherwise(F.col("note"))).drop("_at")


def like_search(rows: DataFrame, keyword: str, columns: tuple[str, ...] = ("name", "content")) -> DataFrame:
    """Rows with a column like %keyword%, ignoring case; % and _ in the keyword are wildcards."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.col(c).ilike(f"%{keyword}%")
    return rows.where(cond)
