"""File listings: archives, quotas, catalogs, status and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.text import (
    basename, dirname, is_hidden, joined_path, normalize_folder, refusal_reason,
)
from tallyglass.operators.ordered import first_per_key
from tallyglass.scale import durable

# Limits of one workspace.
MAX_FILES, MAX_PAGES, MAX_FILE_MB = 50, 1000, 20
CATALOG_FILES, CATALOG_SHEETS, CATALOG_HEADERS = 60, 40, 30


def supported_file(files: DataFrame, max_mb: int = MAX_FILE_MB) -> DataFrame:
    """Drop hidden and lock files, give the others a refusal reason or null."""
    return files.where(~is_hidden(F.col("name"))).withColumn(
        "reason", refusal_reason(F.col("name"), F.col("size"), max_mb)
    )


def archive_entries(entries: DataFrame, max_files: int = MAX_FILES, max_file_mb: int = MAX_FILE_MB,
                    max_total_mb: int = 2 * MAX_PAGES) -> DataFrame:
    """Zip listing(zip, pos, path, size) -> (zip, path, name, folder, status, reason).

    Directories, system folders, hidden and lock files vanish.  Unsupported, oversized and surplus entries
    are reported.  An archive whose kept entries expand past the cap fails as a whole.  Unless every kept
    entry sits under one common top folder, the archive's own name is put in front.

    Only the first ``max_files`` supported entries of an archive are ever ranked; the archive's figures are
    aggregates over those few rows.
    """
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    listed = entries.select("zip", "pos", path.alias("path"), "size").withColumn("name", basename(F.col("path")))
    listed = listed.where(
        (F.col("name") != "") & ~F.col("path").startswith("__MACOSX/") & ~is_hidden(F.col("name"))
    ).withColumn("reason", refusal_reason(F.col("name"), F.col("size"), max_file_mb))
    wanted = listed.where(F.col("reason").isNull())
    kept = first_per_key(wanted, ["zip"], [F.col("pos")], max_files, "_rank")
    nested = F.col("path").contains("/")
    top = F.when(nested, F.substring_index("path", "/", 1))
    figures = kept.groupBy("zip").agg(
        F.sum("size").alias("_total"), F.max("pos").alias("_last_pos"),
        (F.bool_and(nested) & (F.min(top) == F.max(top))).alias("_one_top"),
    )
    joined = listed.join(figures, "zip", "left")
    prefix = F.when(F.col("_one_top"), "").otherwise(F.regexp_replace("zip", r"\.[^.]*$", ""))
    folder = normalize_folder(joined_path(prefix, dirname(F.col("path"))))
    bomb = F.col("_total") > max_total_mb * 1024 * 1024
    reason = F.when(bomb, f"zip expands to more than {max_total_mb} MB").otherwise(
        F.coalesce("reason", F.when(F.col("pos") > F.col("_last_pos"), F.lit("file limit reached")))
    )
    out = joined.select("zip", "path", "name", folder.alias("folder"), reason.alias("reason"))
    return out.withColumn("status", F.when(F.col("reason").isNull(), "ready").otherwise("failed"))


def file_quota(files: DataFrame, session: str, order: str, max_files: int = MAX_FILES,
               max_pages: int = MAX_PAGES) -> DataFrame:
    """(session, order, page_equivalent, verdict); exact for sessions of any size.

    Files are admitted in order while both limits hold; a refused one uses up nothing.  The budget only shrinks, so of the
    files of one size the admitted ones are the first, and no more than fit both limits.  Those few candidates per session and
    size, found by a bounded ranking that runs map-side, are folded in order; every file is then compared with the
    admitted ones.  Null and negative sizes count as no pages.  A null session is a session of its own; files that share a
    place follow in the order they were read.
    """
    named = files.select(session, order, "page_equivalent", F.struct(session).alias("_key"), F.monotonically_increasing_id().alias("_row"))
    laid = durable(named.withColumn("_pages", F.greatest(F.coalesce("page_equivalent", F.lit(0)), F.lit(0))))
    tried = laid.where(F.col("_pages") <= max_pages).select("_key", "_pages", F.col(order).alias("_at"), "_row")
    ranked = first_per_key(tried, ["_key", "_pages"], [F.col("_at"), F.col("_row")], max_files, "_n")
    candidates = ranked.where(F.col("_n") * F.col("_pages") <= max_pages)
    queue = F.array_sort(F.collect_list(F.struct("_at", "_row", F.col("_pages").cast("bigint").alias("_pages"))))
    start = F.struct(F.array().cast("array<bigint>").alias("rows"), F.lit(0).cast("bigint").alias("used"))

    def admit(state: Column, file: Column) -> Column:
        fits = (F.size(state["rows"]) < max_files) & (state["used"] + file["_pages"] <= max_pages)
        return F.when(fits, F.struct(F.array_append(state["rows"], file["_row"]).alias("rows"), (state["used"] + file["_pages"]).alias("used"))
                      ).otherwise(state)

    folded = candidates.groupBy("_key").agg(queue.alias("_queue")).withColumn("_rows", F.aggregate("_queue", start, admit)["rows"])
    # The file that fills the last place; what comes after it meets the file limit.
    last = F.filter("_queue", lambda f: f["_row"] == F.element_at("_rows", -1))[0]
    full = folded.select("_key", "_rows", F.when(F.size("_rows") >= max_files, F.struct(last["_at"], last["_row"])).alias("_full"))
    after = F.struct(F.col(order), F.col("_row")) > F.col("_full") if max_files else F.lit(True)
    verdict = F.when(F.array_contains("_rows", F.col("_row")), "ready").when(
        after, f"file limit reached ({max_files} per session)").otherwise(f"would exceed the {max_pages}-page limit for this session")
    return laid.join(full, "_key", "left").select(session, order, "page_equivalent", verdict.alias("verdict"))


def file_limit(files: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Accept the first ``n`` files of each key and report every other one.

    The n-th file's place is found by a bounded ranking; the rest is one comparison per row.  A null key is a key of
    its own.
    """
    last = first_per_key(files.select(key, order), [key], [F.col(order)], n).groupBy(F.col(key).alias("_key")).agg(
        F.max(order).alias("_last")
    )
    joined = files.join(last, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(
        "reason", F.when(F.col(order) > F.col("_last"), F.lit(f"file limit reached ({n})"))
    ).drop("_key", "_last")


def file_result(name: Column, folder: Column, file_id: Column, pages: Column, chunks: Column,
                error: Column) -> list[Column]:
    """Columns of a status record; a failed file has no id and no chunks."""
    failed = error.isNotNull()
    return [
        F.when(~failed, file_id).alias("file_id"), name.alias("name"), folder.alias("folder"),
        F.when(~failed, pages).alias("pages"), F.when(failed, 0).otherwise(chunks).cast("bigint").alias("chunks"),
        F.when(failed, "failed").otherwise("ready").alias("status"), error.alias("error"),
    ]


def union_status(ready: DataFrame, failed: DataFrame) -> DataFrame:
    return ready.withColumn("status", F.lit("ready")).unionByName(
        failed.withColumn("status", F.lit("failed")), allowMissingColumns=True
    )


def sheet_count(units: DataFrame) -> DataFrame:
    return units.groupBy("file_id").agg(F.countDistinct("sheet").alias("sheets"))


def folder_groups(files: DataFrame) -> DataFrame:
    """Files in display order: by folder, the blank one first, then by name; each with its folder's caption.

    A global sort over (folder, name): its range partitions cut through a large folder.
    """
    blank = F.coalesce(F.col("folder"), F.lit(""))
    caption = F.when(blank == "", "Top level").otherwise(F.concat(blank, F.lit("/")))
    return files.withColumn("folder", blank).withColumn("caption", caption).orderBy("folder", "name")


def missing_files(manifest: DataFrame, indexed: DataFrame) -> DataFrame:
    have = indexed.select("folder", "name").distinct()
    return manifest.join(have, ["folder", "name"], "left_anti")


def document_catalog(files: DataFrame, limit: int = CATALOG_FILES) -> DataFrame:
    """One line for each of the first ``limit`` files(pos, name, folder, pages, sheets, units)."""
    path = joined_path(F.col("folder"), F.col("name"))
    kind = (
        F.when(F.col("sheets") > 0, F.format_string("spreadsheet, %d sheet(s)", "sheets"))
        .when(F.col("pages") > 0, F.format_string("PDF, %d pages", "pages"))
        .otherwise(F.format_string("Word document, %d section(s)", "units"))
    )
    line = F.concat(
        F.lit('- file "'), "name", F.lit('" (folder "'), F.coalesce("folder", F.lit("")), F.lit('", path "'), path,
        F.lit('"): '), kind,
    )
    return files.orderBy("pos").limit(limit).select("pos", line.alias("line"))


def sheet_catalog(sheets: DataFrame, headers: DataFrame, limit: int = CATALOG_SHEETS,
                  max_headers: int = CATALOG_HEADERS) -> DataFrame:
    """One line for each of the first ``limit`` sheets(pos, name, folder, sheet, rows), its first headers listed.

    The sheets are cut to the limit first, so only their headers are joined and collected.
    """
    listed = sheets.orderBy("pos").limit(limit)
    first = first_per_key(
        headers.join(F.broadcast(listed.select("pos")), "pos", "left_semi"), ["pos"], [F.col("col")], max_headers, "_n"
    )
    escaped = F.replace(F.replace("header", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    quoted = F.concat(F.lit('"'), escaped, F.lit('"'))
    names = first.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("col", quoted.alias("q")))).alias("_h"))
    path = joined_path(F.col("folder"), F.col("name"))
    line = F.concat(
        F.lit('- file "'), "name", F.lit('" (folder "'), F.coalesce("folder", F.lit("")), F.lit('", path "'), path,
        F.lit('"), sheet "'), "sheet", F.lit('", '), F.col("rows").cast("string"), F.lit(" data rows, columns: "),
        F.array_join(F.transform("_h", lambda h: h["q"]), ", "),
    )
    return listed.join(names, "pos").select("pos", line.alias("line"))
