"""The registered queries: each one runs an operator over whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.people import AS_OF, NOTES, PEOPLE
from hushframe.functions.masking import mask_email, mask_generic, mask_phone, mask_value
from hushframe.functions.sizes import format_size
from hushframe.functions.text import canonical_text, decode_utf8, lines_of
from hushframe.operators import (
    anonymize_table, anonymize_text, audit, context, conversations, detect, gate, profile_table, profile_text, report,
    rules,
)
from hushframe.plans import folder, release
from hushframe.sources import catalog, delimited, documents, export, split_csv
from hushframe.storage import shared_folder, spread
from hushframe.streaming import tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TASK = "Summarise the data."


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PEOPLE.replace("FROM customer", "FROM {customer}"), customer=spread(table(spark, sf_dir, "customer")))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NOTES.replace("FROM customer", "FROM {customer}"), customer=spread(table(spark, sf_dir, "customer")))


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[canonical_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


# Sources and sinks


@query
def catalog_filters(spark, sf_dir):
    low, high = catalog.size_bounds(1, 4)
    docs = table(spark, sf_dir, "documents").where(catalog.size_filter(F.col("n_chars"), low, high))
    orders = table(spark, sf_dir, "orders").where(catalog.day_filter(F.col("o_orderdate"), "1997-12-31", "1997-01-01"))
    return docs.select(F.lit("documents").alias("source"), F.col("doc_id").alias("id")).unionByName(
        orders.select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"))
    )


@query
def file_kinds(spark, sf_dir):
    name = F.concat(F.col("source"), F.when(F.col("doc_id") % 3 == 0, ".CSV").when(F.col("doc_id") % 3 == 1, ".md").otherwise(""))
    named = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return named.select("doc_id", catalog.extension_of(F.col("name")).alias("extension"), catalog.kind_of(F.col("name")).alias("kind"))


@query
def csv_round_trip(spark, sf_dir):
    path = export.export_table(people(spark, sf_dir), f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}", "people.csv")
    back = delimited.typed(delimited.read_text_table(spark, path))
    return as_text(back)


@query
def delimiter_fallback(spark, sf_dir):
    root = f"{shared_folder(spark)}/delimited-{uuid.uuid4().hex}"
    source = people(spark, sf_dir).select("person_id", "telefon", "city", "date_of_birth")
    for i, delimiter in enumerate(delimited.DELIMITERS):
        part = source.where(F.col("person_id") % len(delimited.DELIMITERS) == i)
        part.write.options(header="true", sep=delimiter, escape='"').csv(f"{root}/{i}")
    folders = [f"{root}/{i}" for i in range(len(delimited.DELIMITERS))]
    rows = [
        t.select(F.lit(d).alias("delimiter"), F.col("person_id").cast("bigint").alias("person_id"), "telefon", "city", "date_of_birth")
        for d, t in delimited.read_by_delimiter(spark, folders, always=True).items()
    ]
    result = rows[0]
    for other in rows[1:]:
        result = result.unionByName(other)
    return result


@query
def csv_mixed_headers(spark, sf_dir):
    """People in files of two headers and two delimiters, with quoted line ends; a comma file must stay one."""
    root = f"{shared_folder(spark)}/mixed-{uuid.uuid4().hex}"
    source = people(spark, sf_dir).withColumn("remark", F.concat("note", F.lit(";a,b\nc,"), "city"))
    shapes = {"0": (("person_id", "city", "remark"), ","), "1": (("remark", "person_id", "telefon"), ","), "2": (("person_id", "date_of_birth"), ";")}
    for i, (names, delimiter) in shapes.items():
        part = source.where(F.col("person_id") % 3 == int(i))
        rows = part.select(*names) if delimiter == "," else part.select("person_id", F.concat(F.lit("x,"), "date_of_birth").alias("date_of_birth"))
        rows.coalesce(1).write.options(header="true", sep=delimiter, escape='"', emptyValue="").csv(f"{root}/{i}")
    tables = delimited.read_tables(spark, [f"{root}/{i}" for i in shapes])
    parts = []
    for (delimiter, header), t in tables.items():
        t = t.withColumns({c: F.lit(None).cast("string") for c in ("city", "remark", "telefon", "date_of_birth") if c not in t.columns})
        parts.append(t.select(F.lit(delimiter).alias("delimiter"), F.lit(header).alias("header"), F.col("person_id").cast("bigint").alias("person_id"), "city", "remark", "telefon", "date_of_birth"))
    result = parts[0]
    for other in parts[1:]:
        result = result.unionByName(other)
    return result


@query
def text_source(spark, sf_dir):
    raw = table(spark, sf_dir, "pages").select("page_id", F.encode(F.concat("html", F.lit("\r\nend\r")), "utf-8").alias("content"))
    return spread(raw).select("page_id", F.md5(decode_utf8(F.col("content"))).alias("digest"))


@query
def preview_rows(spark, sf_dir):
    return delimited.preview_rows(table(spark, sf_dir, "orders"), ["o_orderkey"])


@query
def preview_text(spark, sf_dir):
    return documents.preview_text(table(spark, sf_dir, "documents"), ["doc_id"], "text")


# Profiles


@query
def profile_counts(spark, sf_dir):
    return profile_table.counts(table(spark, sf_dir, "lineitem"))


@query
def profile_schema(spark, sf_dir):
    return profile_table.missing(table(spark, sf_dir, "events")).select("column_ord", "column", "dtype", "row_count")


@query
def profile_missing(spark, sf_dir):
    return profile_table.missing(people(spark, sf_dir)).select("column_ord", "column", "missing")


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.withColumns({c: F.round(c, 4) for c in ("min", "max", "mean", "median")})


@query
def profile_numeric(spark, sf_dir):
    return _rounded(profile_table.numeric_stats(table(spark, sf_dir, "lineitem")))


@query
def profile_numeric_nulls(spark, sf_dir):
    return _rounded(profile_table.numeric_stats(people(spark, sf_dir)))


@query
def profile_top_values(spark, sf_dir):
    return profile_table.top_values(table(spark, sf_dir, "orders"))


@query
def profile_top_values_nulls(spark, sf_dir):
    return profile_table.top_values(people(spark, sf_dir))


@query
def profile_top_values_texts(spark, sf_dir):
    return profile_table.top_values(table(spark, sf_dir, "documents"))


@query
def profile_duplicates(spark, sf_dir):
    """All columns; the first lines of the orders come twice."""
    lines = table(spark, sf_dir, "lineitem")
    return profile_table.duplicate_rows(lines.unionByName(lines.where("l_linenumber = 1")))


@query
def profile_duplicates_wide(spark, sf_dir):
    """All columns; the English documents come twice."""
    docs = table(spark, sf_dir, "documents")
    return profile_table.duplicate_rows(docs.unionByName(docs.where("lang = 'en'")), by_digest=True)


@query
def text_profile(spark, sf_dir):
    return profile_text.text_counts(spread(table(spark, sf_dir, "documents")), ["doc_id"], "text")


@query
def keywords_by_doc(spark, sf_dir):
    return profile_text.keywords_by_text(spread(table(spark, sf_dir, "documents")), ["doc_id"], "text")


@query
def keywords_by_lang(spark, sf_dir):
    return profile_text.keywords_by_group(spread(table(spark, sf_dir, "documents")), ["doc_id"], "text", ["lang"])


# Detection


@query
def column_flags(spark, sf_dir):
    df = people(spark, sf_dir)
    cells = detect.text_cells(df, [], df.columns)
    flags = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.lit(getattr(rules.column_flags(c), n)).alias(f"is_{n}") for n in detect.FLAG_NAMES])
            for c in df.columns
        ]
    )
    counts = cells.groupBy("column_ord", "column").agg(F.count(F.lit(1)).alias("cells"))
    found = counts.select("column", "cells", flags[F.col("column_ord")].alias("f"))
    return found.select("column", "cells", *[F.col(f"f.is_{n}") for n in detect.FLAG_NAMES])


def _pii_cells(mode: str) -> Query:
    return lambda spark, sf_dir: detect.detect_table(people(spark, sf_dir), ["person_id"], mode, AS_OF, "people")


for _mode in ("strict", "balanced", "relaxed"):
    QUERIES[f"pii_cells_{_mode}"] = _pii_cells(_mode)


@query
def pii_cells_orders(spark, sf_dir):
    return detect.detect_table(spread(table(spark, sf_dir, "orders")), ["o_orderkey"], "strict", AS_OF, "orders")


@query
def pii_cells_events(spark, sf_dir):
    return detect.detect_table(spread(table(spark, sf_dir, "events")), ["event_id"], "balanced", AS_OF, "events")


@query
def pii_text_documents(spark, sf_dir):
    return detect.detect_text(spread(table(spark, sf_dir, "documents")), ["doc_id"], "text", "strict", AS_OF, "documents")


@query
def pii_text_pages(spark, sf_dir):
    return detect.detect_text(spread(table(spark, sf_dir, "pages")), ["page_id"], "html", "strict", AS_OF, "pages")


@query
def pii_text_conversations(spark, sf_dir):
    """Every fifth turn leaves an address and a number."""
    contact = F.concat("text", F.lit("\nnovak"), F.col("conv_id").cast("string"), F.lit("@example.com, +420 602 123 456"))
    turns = spread(table(spark, sf_dir, "conversations"))
    left = turns.select("conv_id", "turn", F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, contact).otherwise(F.col("text")).alias("text"))
    return detect.detect_text(left, ["conv_id", "turn"], "text", "balanced", AS_OF, "conversations")


def _pii_notes(mode: str) -> Query:
    return lambda spark, sf_dir: detect.detect_text(notes(spark, sf_dir), ["doc_id"], "text", mode, AS_OF, "notes")


for _mode in ("strict", "relaxed"):
    QUERIES[f"pii_text_notes_{_mode}"] = _pii_notes(_mode)


# Reports


def _found(spark, sf_dir):
    return detect.detect_table(people(spark, sf_dir), ["person_id"], "strict", AS_OF, "people")


@query
def pii_report_totals(spark, sf_dir):
    return report.totals_by_type(_found(spark, sf_dir))


@query
def pii_report_columns(spark, sf_dir):
    return report.columns_by_type(_found(spark, sf_dir)).withColumn("columns", F.array_join("columns", ","))


@query
def pii_report_rows(spark, sf_dir):
    return report.rows_by_type(_found(spark, sf_dir), ["person_id"])


@query
def pii_has_pii(spark, sf_dir):
    return report.has_pii(_found(spark, sf_dir))


def _safe(spark, sf_dir):
    """Reviewed as safe: the postcodes in notes and the names of customers with a negative balance.

    Marks of another dataset and of another mode, for all other customers, must change nothing.
    """
    pairs = F.array(
        F.struct(F.lit("note").alias("column"), F.lit("ADDRESS").alias("pii_type"), F.lit("postcode_heuristic").alias("rule")),
        F.struct(F.lit("name").alias("column"), F.lit("NAME").alias("pii_type"), F.lit("column_name_heuristic").alias("rule")),
    )
    own = F.col("c_acctbal") < 0
    return table(spark, sf_dir, "customer").select(
        F.when(own | (F.col("c_custkey") % 2 == 0), "people").otherwise("others").alias("dataset"),
        F.when(own | (F.col("c_custkey") % 2 == 1), "Strict").otherwise("Relaxed").alias("mode"),
        F.col("c_custkey").alias("person_id"), F.inline(pairs),
    )


@query
def pii_effective_strict(spark, sf_dir):
    return report.effective_findings(_found(spark, sf_dir), _safe(spark, sf_dir), ["person_id"], "strict")


@query
def pii_masked_samples(spark, sf_dir):
    return report.masked_samples(_found(spark, sf_dir), ["column_ord", "person_id", "rule_order"])


@query
def audit_detection_summary(spark, sf_dir):
    """People, and the regions, which are scanned and clean."""
    regions = detect.detect_table(table(spark, sf_dir, "region"), ["r_regionkey"], "strict", AS_OF, "regions")
    names = ["dataset", "pii_type"]
    found = _found(spark, sf_dir).select(names).unionByName(regions.select(names))
    scanned = spark.range(1).select(F.explode(F.array(F.lit("people"), F.lit("regions"))).alias("dataset"))
    return audit.detection_summary(found, "strict", scanned)


@query
def audit_events(spark, sf_dir):
    """The events of the other steps, for people and for the requests."""
    df = people(spark, sf_dir)
    cells = detect.detect_cells(df, ["person_id"], "strict", AS_OF)
    replaced = anonymize_table.token_dictionary(cells, ["person_id"]).replaced_counts()
    decided = gate.release_decisions(_with_state(spark, sf_dir).withColumn("use_anonymized", F.col("wants_anonymized")))
    decided = decided.withColumns({
        "mode": F.lit("Strict"), "scope": F.lit("schema"), "source": F.lit("original"), "sample_rows": F.col("turn"),
    })
    return (
        audit.profiling_completed(profile_table.counts(df), "people", "csv")
        .unionByName(audit.anonymization_completed(replaced, "people", "strict"))
        .unionByName(audit.safe_marked(_safe(spark, sf_dir)))
        .unionByName(audit.release_decided(decided))
    )


# Masks


@query
def audit_log(spark, sf_dir):
    """A log with the detection events of two runs, one of which was repeated."""
    path = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    events = audit.detection_summary(_found(spark, sf_dir), "strict")
    for run in ("first", "second", "first"):
        audit.append(events, path, run)
    return audit.read_log(spark, path).drop("part")


@query
def mask_emails(spark, sf_dir):
    return people(spark, sf_dir).select(
        "person_id", mask_email(F.col("email")).alias("email"), mask_email(F.col("note")).alias("note"),
        mask_email(F.col("note"), rules.EMAIL).alias("note_match"),
    )


@query
def mask_phones(spark, sf_dir):
    return people(spark, sf_dir).select(
        "person_id", mask_phone(F.col("telefon")).alias("telefon"), mask_phone(F.col("city")).alias("city")
    )


@query
def mask_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", mask_generic(F.col("lang")).alias("lang"), mask_generic(F.col("text")).alias("text"))


@query
def mask_by_type(spark, sf_dir):
    kind = F.when(F.col("c_custkey") % 3 == 0, "email").when(F.col("c_custkey") % 3 == 1, "PHONE").otherwise("Name")
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", mask_value(F.when(F.col("c_acctbal") > 0, F.col("c_name")), kind).alias("masked"))


# Anonymization


@query
def token_dictionary_cells(spark, sf_dir):
    return anonymize_table.token_dictionary(
        detect.detect_cells(people(spark, sf_dir), ["person_id"], "strict", AS_OF), ["person_id"]
    ).entries


@query
def token_map_cells(spark, sf_dir):
    cells = detect.detect_cells(people(spark, sf_dir), ["person_id"], "strict", AS_OF)
    return anonymize_table.token_dictionary(cells, ["person_id"]).token_map()


@query
def anonymized_people(spark, sf_dir):
    return as_text(anonymize_table.anonymize_table(people(spark, sf_dir), ["person_id"], "strict", AS_OF).table)


@query
def anonymized_people_joined(spark, sf_dir):
    """The way of large tables: no dictionary is broadcast as a whole."""
    df = people(spark, sf_dir)
    return as_text(anonymize_table.anonymize_table(df, ["person_id"], "strict", AS_OF, broadcast_bytes=0).table)


def _keyless(spark, sf_dir):
    """People whose key is null or repeats in half of the rows."""
    key = F.when(F.col("person_id") % 4 == 0, F.lit(None)).when(F.col("person_id") % 4 == 1, 1).otherwise(F.col("person_id"))
    return people(spark, sf_dir).select(key.cast("bigint").alias("row_key"), "email", "telefon", "rodne_cislo", "city", "note")


@query
def anonymized_keyless(spark, sf_dir):
    """Counts of each form of a cell after replacement: token types only, since numbers of tied rows are not fixed."""
    return _forms(anonymize_table.anonymize_table(_keyless(spark, sf_dir), ["row_key"], "strict", AS_OF).table)


@query
def anonymized_keyless_joined(spark, sf_dir):
    return _forms(anonymize_table.anonymize_table(_keyless(spark, sf_dir), ["row_key"], "strict", AS_OF, broadcast_bytes=0).table)


def _forms(df: DataFrame) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.regexp_replace(c, r"^([A-Z]+)_\d+$", "$1_").alias("form")) for c in df.columns[1:]])
    return df.select(F.inline(cells)).groupBy("column", "form").agg(F.count(F.lit(1)).alias("cells"))


@query
def anonymized_people_effective(spark, sf_dir):
    df = people(spark, sf_dir)
    done = anonymize_table.anonymize_table(df, ["person_id"], "strict", AS_OF, safe=_safe(spark, sf_dir), dataset="people")
    return as_text(done.table)


@query
def streamed_people(spark, sf_dir):
    """People anonymized as a stream of two micro-batches: a value of the first keeps its token in the second."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = people(spark, sf_dir)
    made = tokens.StreamTokens(spark, f"{root}/tokens", ["person_id"], "strict", AS_OF)
    for batch in (0, 1):
        source.where(F.col("person_id") % 2 == batch).write.mode("append").parquet(f"{root}/in")
        made.start(spark.readStream.schema(source.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/checkpoint", availableNow=True).awaitTermination()
    return as_text(spark.read.parquet(f"{root}/out").drop("batch"))


@query
def streamed_tokens(spark, sf_dir):
    """The dictionary that a stream of two batches of orders leaves, with the batch that each value came in first."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spread(table(spark, sf_dir, "orders"))
    made = tokens.StreamTokens(spark, root, ["o_orderkey"], "balanced", AS_OF)
    for batch in (0, 1):
        made.anonymize(source.where(F.col("o_custkey") % 2 == batch), batch)
    return made.entries()


@query
def anonymized_orders(spark, sf_dir):
    return as_text(anonymize_table.anonymize_table(spread(table(spark, sf_dir, "orders")), ["o_orderkey"], "balanced", AS_OF).table)


@query
def replaced_counts(spark, sf_dir):
    cells = detect.detect_cells(people(spark, sf_dir), ["person_id"], "strict", AS_OF)
    return anonymize_table.token_dictionary(cells, ["person_id"]).replaced_counts()


@query
def token_dictionary_text(spark, sf_dir):
    return anonymize_text.text_dictionary(notes(spark, sf_dir), ["doc_id"], "text", "strict", AS_OF)


@query
def anonymized_notes(spark, sf_dir):
    return anonymize_text.anonymize_text(notes(spark, sf_dir), "text", "strict", AS_OF)


@query
def anonymized_notes_effective(spark, sf_dir):
    """Reviewed as safe: the phone numbers in the second line of the notes of customers with a negative balance."""
    own = F.col("c_acctbal") < 0
    safe = table(spark, sf_dir, "customer").select(
        F.when(own | (F.col("c_custkey") % 2 == 0), "notes").otherwise("others").alias("dataset"),
        F.when(own | (F.col("c_custkey") % 2 == 1), "Strict").otherwise("Balanced").alias("mode"),
        F.col("c_custkey").alias("doc_id"), F.lit(2).alias("line_no"), F.lit("PHONE").alias("pii_type"), F.lit("regex_text").alias("rule"),
    )
    return anonymize_text.anonymize_text(notes(spark, sf_dir), "text", "strict", AS_OF, safe, ["doc_id"], "notes")


@query
def anonymized_documents(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return anonymize_text.anonymize_text(docs, "text", "strict", AS_OF)


@query
def replaced_counts_text(spark, sf_dir):
    return anonymize_text.replaced_counts(notes(spark, sf_dir), "text", "strict", AS_OF)


# Context and payload


@query
def context_schema(spark, sf_dir):
    """Every column of the listing with the rows it describes."""
    df = people(spark, sf_dir)
    one = context.table_context(df, ["person_id"], "strict", "schema", "people")
    rows = profile_table.counts(df).select("row_count")
    listed = one.select("dataset", "scope", F.inline("profile.schema"))
    return listed.withColumn("_one", F.lit(1)).join(F.broadcast(rows.withColumn("_one", F.lit(1))), "_one").drop("_one")


@query
def context_stats(spark, sf_dir):
    one = context.table_context(people(spark, sf_dir), ["person_id"], "balanced", "schema+stats", "people", decimals=4)
    listed = one.select(
        "dataset", "privacy_mode", "scope", "profile.row_count", "profile.column_count", "profile.duplicate_rows",
        "profile.missing_by_column", "profile.numeric_stats", F.inline("profile.schema"),
    )
    stats = F.try_element_at("numeric_stats", F.col("column"))
    return listed.select(
        "dataset", "privacy_mode", "scope", "row_count", "column_count", "duplicate_rows", "column", "dtype",
        F.element_at("missing_by_column", F.col("column")).alias("missing"),
        *[stats[n].alias(n) for n in ("min", "max", "mean", "median")],
    )


@query
def context_text(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    one = context.text_context(docs, ["doc_id"], "text", "balanced", "schema")
    return one.select(
        "doc_id", "file_kind", "privacy_mode", "scope", "profile.char_count", "profile.line_count", "profile.word_count",
        F.array_join(F.transform("profile.keywords", lambda k: F.concat_ws(":", k["term"], k["count"].cast("string"))), ",").alias("keywords"),
    )


@query
def id_like_columns(spark, sf_dir):
    return context.id_like_columns(table(spark, sf_dir, "events"))


def _sample(mode: str) -> Query:
    def run(spark, sf_dir):
        sample = context.sample_rows(table(spark, sf_dir, "events"), ["event_id"], mode)
        return sample.drop("_sample_order_0")

    return run


for _mode in ("strict", "balanced", "relaxed"):
    QUERIES[f"sample_{_mode}"] = _sample(_mode)


@query
def sample_lines(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    one = context.text_context(docs, ["doc_id"], "text", "strict", "schema+stats+sample")
    return one.select("doc_id", "sample_row_count", F.posexplode("sample_rows").alias("line_no", "line"))


@query
def payload_size_guard(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    one = context.text_context(docs, ["doc_id"], "text", "strict", "schema+stats+sample")
    return context.release_payload(one, F.lit(TASK), 2048).select("doc_id", "truncated", "payload_bytes", "still_over")


@query
def release_payload_table(spark, sf_dir):
    return release.release_table(
        people(spark, sf_dir), ["person_id"], "strict", AS_OF, "schema+stats+sample", F.lit(TASK), "people", decimals=4
    ).payload


@query
def release_payload_texts(spark, sf_dir):
    return release.release_texts(
        notes(spark, sf_dir), ["doc_id"], "text", "balanced", AS_OF, "schema+stats+sample", F.lit(TASK)
    )


@query
def release_payload_cells(spark, sf_dir):
    """The payload of the table, read back: each sampled cell with the rows and missing values of its column."""
    payload = release_payload_table(spark, sf_dir)
    shape = "dataset struct<sample: array<map<string,string>>, stats: struct<row_count: bigint, missing_by_column: map<string,bigint>>>"
    read = payload.select(F.from_json("payload", shape).alias("p")).select("p.dataset.*")
    rows = read.select("stats", F.posexplode("sample").alias("row_no", "row"))
    cells = rows.select("stats", F.col("row_no").cast("bigint").alias("row_no"), F.explode("row").alias("column", "value"))
    missing = F.element_at("stats.missing_by_column", F.col("column"))
    return cells.select("row_no", "column", "value", F.col("stats.row_count").alias("row_count"), missing.alias("missing"))


@query
def release_payload_stats(spark, sf_dir):
    """The rest of the payload of the table, read back: task, schema, counts, missing values and numbers."""
    numbers = "struct<min: double, max: double, mean: double, median: double>"
    stats = f"struct<row_count: bigint, column_count: bigint, missing_by_column: map<string,bigint>, numeric_stats: map<string,{numbers}>, duplicate_rows: bigint>"
    shape = f"task string, dataset struct<schema: array<struct<column: string, dtype: string>>, stats: {stats}>"
    read = release_payload_table(spark, sf_dir).select(F.from_json("payload", shape).alias("p")).select("p.task", "p.dataset.*")

    def part(name, df, column, text=None, number=None):
        return df.select(
            F.lit(name).alias("part"), column.alias("column"), (F.lit(None) if text is None else text).cast("string").alias("text"),
            (F.lit(None) if number is None else number).cast("double").alias("number"),
        )

    whole = F.lit("")
    parts = [part("task", read, whole, F.col("task")), part("schema", read.select(F.inline("schema")), F.col("column"), F.col("dtype"))]
    parts += [part(n, read, whole, number=F.col(f"stats.{n}")) for n in ("row_count", "column_count", "duplicate_rows")]
    parts.append(part("missing", read.select(F.explode("stats.missing_by_column").alias("column", "n")), F.col("column"), number=F.col("n")))
    numeric = read.select(F.explode("stats.numeric_stats").alias("column", "s"))
    parts += [part(n, numeric, F.col("column"), number=F.col(f"s.{n}")) for n in ("min", "max", "mean", "median")]
    result = parts[0]
    for other in parts[1:]:
        result = result.unionByName(other)
    return result


@query
def payload_default_limit(spark, sf_dir):
    """Documents as a table: their sample is over the usual limit, what is left is not."""
    docs = spread(table(spark, sf_dir, "documents"))
    payload = release.release_table(docs, ["doc_id"], "relaxed", AS_OF, "schema+stats+sample", F.lit(TASK), "documents").payload
    sample = F.size(F.from_json("payload", "dataset struct<sample: array<map<string,string>>>")["dataset"]["sample"])
    return payload.select("truncated", "still_over", (F.coalesce(sample, F.lit(0)) > 0).alias("has_sample"), (F.col("payload_bytes") <= 204_800).alias("fits"))


@query
def release_payload_lines(spark, sf_dir):
    """The payloads of the texts, read back line by line."""
    sample = F.from_json("payload", "dataset struct<sample: array<string>>")["dataset"]["sample"]
    return release_payload_texts(spark, sf_dir).select("doc_id", F.posexplode(sample).alias("line_no", "line"))


@query
def text_export(spark, sf_dir):
    path = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    export.export_texts(anonymize_text.anonymize_text(notes(spark, sf_dir), "text", "strict", AS_OF), path)
    return spark.read.parquet(path)


def _csv(df, path, **options):
    """As many files as there are tasks, each with a header."""
    df.write.options(header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", **options).csv(path)


def _raw_lines(lines, path):
    """Files of given lines (`bucket`, `place`, `line`) as they are, one for each bucket, in Latin-1: its letters are no UTF-8."""
    plain = {"header": "false", "sep": "\u0001", "quote": "\u0002", "escapeQuotes": "false", "emptyValue": "", "encoding": "ISO-8859-1"}
    ordered = lines.repartition(8, "bucket").sortWithinPartitions("bucket", "place").select("bucket", "line")
    ordered.write.partitionBy("bucket").options(ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", **plain).csv(path)


def _damaged_customers(spark, sf_dir):
    """Customers in files of up to 1,000: of ten keys, one has a surplus field with an e-mail, one lacks a field, one is no
    UTF-8, and the others have a quoted line end."""
    key, label = F.col("c_custkey"), F.col("c_mktsegment")
    named, kind = F.concat(F.lit("c"), key.cast("string")), key % 10
    text = (
        F.when(kind == 1, F.concat(named, F.lit(","), label, F.lit(",extra"), key.cast("string"), F.lit("@example.com")))
        .when(kind == 2, named)
        .when(kind == 3, F.concat(named, F.lit(",caf\u00e9 "), label))
        .otherwise(F.concat(named, F.lit(',"'), label, F.lit("\n"), label, F.lit('"')))
    )
    bucket = F.floor(key / 1000)
    rows = spread(table(spark, sf_dir, "customer")).select(bucket.alias("bucket"), key.alias("key"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    rows = rows.select("bucket", F.struct(F.col("key"), F.col("at")).alias("place"), "line")
    first = rows.select("bucket").distinct().select("bucket", F.struct(F.lit(-1).cast("bigint").alias("key"), F.lit(0).alias("at")).alias("place"), F.lit("code,label").alias("line"))
    return rows.unionByName(first)


@query
def folder_exploration(spark, sf_dir):
    """A folder with people, regions and damaged files of customers as CSV, a file with a header only, and notes as text
    files: what its trail, its profile and its findings say about each part."""
    root = f"{shared_folder(spark)}/folder-{uuid.uuid4().hex}"
    _csv(as_text(people(spark, sf_dir)), f"{root}/people")
    _csv(as_text(table(spark, sf_dir, "region")), f"{root}/regions")
    _csv(spark.createDataFrame([], "left string, right string"), f"{root}/bare")
    _raw_lines(_damaged_customers(spark, sf_dir), f"{root}/damaged")
    notes(spark, sf_dir).select("text").write.text(f"{root}/notes")
    explored = folder.explore_folder(spark, root, "strict", AS_OF)
    label = F.regexp_extract("dataset", "/(people|regions|notes|bare|damaged)/", 1).alias("dataset")
    # Clean and unknown files have one event each, however many there are of a part.
    events = explored.events.where("event <> 'file_loaded'").select(label, "event", "subject", "detail", "amount")
    events = events.groupBy("dataset", "event", "subject", "detail").agg(F.sum("amount").alias("amount"))
    sizes = explored.profile.groupBy(label).agg(F.max("column_count").cast("string").alias("detail"), F.sum(F.coalesce("row_count", "word_count")).alias("amount"))
    sizes = sizes.select("dataset", F.lit("profile").alias("event"), F.lit("size").alias("subject"), "detail", "amount")
    found = explored.findings.groupBy(label, F.col("column").alias("detail"), "pii_type").agg(F.count(F.lit(1)).alias("amount"))
    found = found.select("dataset", F.lit("findings").alias("event"), F.col("pii_type").alias("subject"), "detail", "amount")
    loaded = explored.events.where("event = 'file_loaded'").join(explored.files.withColumnRenamed("path", "dataset"), "dataset", "left_anti")
    loaded = loaded.select(F.lit("files").alias("dataset"), F.lit("file_loaded").alias("event"), F.lit("unlisted").alias("subject"), F.lit("").alias("detail"), F.lit(1).cast("bigint").alias("amount"))
    return events.unionByName(sizes).unionByName(found).unionByName(loaded)


@query
def csv_quarantine(spark, sf_dir):
    """The records that do not fit their table, why, and how many e-mails they hold."""
    root = f"{shared_folder(spark)}/damaged-{uuid.uuid4().hex}"
    _raw_lines(_damaged_customers(spark, sf_dir), root)
    explored = folder.explore_folder(spark, root, "strict", AS_OF)
    mails = explored.findings.where("column = '(record)' and pii_type = 'EMAIL'").groupBy("dataset", "place").agg(F.count(F.lit(1)).alias("found"))
    listed = explored.quarantine.join(mails, ["dataset", "place"], "left")
    return listed.select(
        F.substring(F.substring_index("record", ",", 1), 2, 20).cast("bigint").alias("person_id"), F.explode("reasons").alias("reason"),
        F.coalesce("found", F.lit(0)).cast("bigint").alias("found"),
    )


@query
def csv_split_records(spark, sf_dir):
    """All lines of orders with quoted line ends, quotes and delimiters in a field, cut in splits far smaller than the files."""
    root = f"{shared_folder(spark)}/split-{uuid.uuid4().hex}"
    remark = F.concat("l_returnflag", F.lit('," '), "l_linestatus", F.when(F.col("l_linenumber") % 3 == 0, F.lit("\n\n,x\n")).otherwise(F.lit("")))
    source = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", remark.alias("remark"), "l_linenumber", "l_suppkey")
    _csv(source.repartition(4, "l_orderkey"), root)
    before = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        # The records are cut, and written, inside this call.
        for name, value in zip(before, ("96k", "8k"), strict=True):
            spark.conf.set(name, value)
        tables = split_csv.read_split_tables(spark, [root])
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    numbers = ("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    (made,) = tables
    return made.rows.select(*[F.col(c).cast("bigint").alias(c) for c in numbers], "remark")


@query
def folder_refresh(spark, sf_dir):
    """A folder explored, extended and explored again with a store: the profile and findings of all, and what was read anew."""
    root, store = (f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}" for name in ("grown", "store"))
    source = as_text(people(spark, sf_dir))
    half = F.col("person_id").cast("bigint") % 2
    _csv(source.where(half == 0), f"{root}/even")
    folder.explore_folder(spark, root, "strict", AS_OF, store)
    _csv(source.where(half == 1), f"{root}/odd")
    explored = folder.explore_folder(spark, root, "strict", AS_OF, store)
    rows = explored.profile.agg(F.sum("row_count").alias("amount")).select(F.lit("all rows").alias("part"), "amount")
    anew = explored.profile.join(explored.read.select(F.col("path").alias("dataset")), "dataset", "left_semi")
    anew = anew.agg(F.sum("row_count").alias("amount")).select(F.lit("rows read again").alias("part"), "amount")
    found = explored.findings.groupBy(F.col("pii_type").alias("part")).agg(F.count(F.lit(1)).alias("amount"))
    return rows.unionByName(anew).unionByName(found)


@query
def text_lines(spark, sf_dir):
    """The texts of documents in text files read by lines: each line as often as it is there."""
    root = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select("text").write.text(root)
    lines, _ = documents.read_text_lines(spark, root)
    single = lines.select(F.explode(lines_of(F.col("text"))).alias("line")).where("line <> ''")
    return single.groupBy(F.md5("line").alias("digest")).agg(F.count(F.lit(1)).alias("amount"))


# Gate and conversations


def _requests(spark, sf_dir):
    """One request per user turn: longer prompts were submitted, every third conversation asks for tokens.

    Every eleventh request lacks a flag, and some name no dataset or one that was never scanned.
    """
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    unless = lambda part, flag: F.when((F.col("conv_id") + F.col("turn")) % 11 != part, flag)
    return turns.select(
        F.col("conv_id"), F.col("turn"), F.when(F.col("conv_id") % 13 != 0, F.col("conv_id") % 150).alias("dataset"),
        F.when(F.col("conv_id") % 7 == 0, F.lit(" \n\t")).otherwise(F.col("text")).alias("prompt"),
        unless(1, F.length("text") > 60).alias("submitted"),
        unless(2, F.col("conv_id") % 3 == 0).alias("wants_anonymized"),
        unless(3, F.col("turn") == 0).alias("anonymized_available"),
    )


def _with_state(spark, sf_dir):
    """All findings count. Of the notes, those of every fifth customer have no contact data; every sixth were not scanned."""
    df = notes(spark, sf_dir)
    clean = F.when(F.col("doc_id") % 5 == 0, F.lit("bez údajů")).otherwise(F.col("text"))
    scanned = df.where("doc_id % 6 <> 0").select("doc_id", clean.alias("text"))
    found = detect.detect_text(scanned, ["doc_id"], "text", "relaxed", AS_OF, "notes")
    return gate.with_pii_state(
        _requests(spark, sf_dir), found.select(F.col("doc_id").alias("dataset")), scanned.select(F.col("doc_id").alias("dataset"))
    )


@query
def release_decisions(spark, sf_dir):
    decided = gate.release_decisions(_with_state(spark, sf_dir).withColumn("use_anonymized", F.col("wants_anonymized")))
    return decided.select("conv_id", "turn", "has_pii", "reason")


@query
def released_requests(spark, sf_dir):
    decided = gate.release_decisions(_with_state(spark, sf_dir).withColumn("use_anonymized", F.col("wants_anonymized")))
    return gate.released(decided).select("conv_id", "turn")


@query
def release_source(spark, sf_dir):
    sourced = gate.release_source(_with_state(spark, sf_dir)).withColumn("use_anonymized", F.col("source") == "anonymized")
    return gate.release_decisions(sourced).select("conv_id", "turn", "source", "source_missing", "reason")


@query
def conversation_newest_first(spark, sf_dir):
    return conversations.newest_first(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "role", "text", "turn_group", "position"
    )


@query
def conversation_tied_turns(spark, sf_dir):
    """Two messages in each turn, and one conversation of a third of all rows, which is ordered across tasks."""
    turns = table(spark, sf_dir, "conversations")
    merged = turns.select(
        F.when(F.col("conv_id") % 3 == 0, -1).otherwise(F.col("conv_id")).alias("conv_id"),
        F.expr("(conv_id * 64 + turn) div 2").alias("turn"), "role", "text",
    )
    limit = max(1, merged.count() // 10)
    return conversations.newest_first(merged, long_rows=limit).select("conv_id", "turn", "role", F.md5("text").alias("digest"), "turn_group", "position")


@query
def conversation_without_users(spark, sf_dir):
    """Two thirds of all messages without an id or without a user: one long conversation each, the latter of one group."""
    turns = table(spark, sf_dir, "conversations")
    merged = turns.select(
        F.when(F.col("conv_id") % 3 == 0, F.lit(None)).when(F.col("conv_id") % 3 == 1, -1).otherwise(F.col("conv_id")).alias("conv_id"),
        (F.col("conv_id") * 64 + F.col("turn")).alias("turn"), F.when(F.col("conv_id") % 3 == 1, "system").otherwise(F.col("role")).alias("role"), "text",
    )
    limit = max(1, merged.count() // 10)
    return conversations.newest_first(merged, long_rows=limit).select(F.coalesce("conv_id", F.lit(-2)).alias("conv_id"), "turn", "role", F.md5("text").alias("digest"), "turn_group", "position")


@query
def conversation_append(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations")
    replies = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("conv_id"), F.concat(F.lit("  "), F.col("lang"), F.lit("\n")).alias("prompt"), F.col("source").alias("reply")
    )
    return conversations.append_pair(messages, replies)


@query
def content_normalise(spark, sf_dir):
    text = F.col("text")
    part = F.to_json(F.array(F.struct(text.alias("text")), F.struct(F.col("role").alias("text"))))
    plain = F.to_json(F.array(F.col("role"), text))
    stored = F.when(F.col("turn") % 3 == 0, part).when(F.col("turn") % 3 == 1, plain).otherwise(text)
    return spread(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", conversations.normalise_content(stored).alias("content")
    )


@query
def format_sizes(spark, sf_dir):
    size = F.col("n_chars") * F.pow(F.lit(1024), F.col("doc_id") % 4).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", format_size(size).alias("shown"))
