"""Projections to the output tables, and the batch build that feeds all six."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.dates import is_fresh, normalize_date, utc_moment
from ..functions.urls import arxiv_month_start
from ..operators.resolve import DEFAULT_THRESHOLD, mapping_log, resolve
from ..schemas import OUTPUT_COLUMNS, SCHEMA_VERSION
from ..session import Workspace

# Startups come before jobs in arrival order.
_TABLE_STRIDE = 1 << 56


def iso_stamp(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def _table(df: DataFrame, table: str, record_type: str, collected_at: Column, **columns: Column) -> DataFrame:
    """Constant envelope columns around the given ones, in the order of the table."""
    values = {
        "schemaVersion": F.lit(SCHEMA_VERSION),
        "recordType": F.lit(record_type),
        "collectedAt": iso_stamp(collected_at),
        **{name.replace("__", "."): column for name, column in columns.items()},
    }
    return df.select(*[values[name].alias(name) for name in OUTPUT_COLUMNS[table]])


def startups_table(df: DataFrame, name: Column, source_name: Column, collected_at: Column) -> DataFrame:
    return _table(
        df, "startups", "STARTUP", collected_at,
        source__name=source_name, source__url=F.col("source_url"),
        content__entityName=name, content__data__employeeCount=F.col("employeeCount"),
    )


def products_table(df: DataFrame, name: Column, source_name: Column, collected_at: Column) -> DataFrame:
    return _table(
        df, "products", "PRODUCT", collected_at,
        source__name=source_name, source__url=F.col("source_url"),
        content__startupName=name, content__pricingModel=F.lit(""), content__description=F.col("description"),
    )


def with_paper_defaults(df: DataFrame, source_name: str, source_url: str) -> DataFrame:
    """Month from the arXiv id, no authors, and a constant source."""
    return df.withColumns(
        {
            "published_date": arxiv_month_start(F.col("paper_url")),
            "authors": F.coalesce(F.col("authors"), F.array().cast("array<string>"))
            if "authors" in df.columns
            else F.array().cast("array<string>"),
            "source_name": F.lit(source_name),
            "source_url": F.lit(source_url),
        }
    )


def papers_table(df: DataFrame, collected_at: Column) -> DataFrame:
    """The source address of a paper is the paper itself."""
    return _table(
        df, "research_papers", "RESEARCH_PAPER", collected_at,
        source__name=F.col("source_name"), source__url=F.col("paper_url"),
        content__title=F.col("title"),
        content__authors=F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", "),
        content__paper_url=F.col("paper_url"), content__github_url=F.col("github_url"),
        content__github_stars=F.col("github_stars"), content__published_date=F.col("published_date"),
    )


def jobs_table(df: DataFrame, company: Column, collected_at: Column) -> DataFrame:
    """The date stays as it was written."""
    return _table(
        df, "jobs", "JOB", collected_at,
        source__name=F.col("source_name"), source__url=F.col("source_url"),
        content__company=company, content__title=F.col("title"), content__date=F.col("date"),
        content__is_remote=F.col("is_remote"), content__role_family=F.col("role_family"),
    )


def news_table(df: DataFrame, collected_at: Column) -> DataFrame:
    return _table(
        df, "news", "NEWS", collected_at,
        source__name=F.col("source_name"), source__url=F.col("source_url"),
        content__title=F.col("title"), content__published_date=F.col("published_date"),
        content__excerpt=F.col("content_excerpt"),
    )


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs to flat columns with dotted names."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for f in schema:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield here

    return df.select(
        *[F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema, ())]
    )


def fresh_only(df: DataFrame, date_col: str, reference_time: Column | datetime, window_hours: int = 24) -> DataFrame:
    parsed = normalize_date(F.col(date_col), reference_time)
    return df.filter(is_fresh(parsed["value"], reference_time, window_hours))


def fresh_by_date(
    df: DataFrame, date_col: str, reference_time: datetime, work: Workspace, window_hours: int = 24
) -> DataFrame:
    """`fresh_only` for dates that repeat: each is read once, and rows are joined with the fresh ones."""
    # Written down: the gate would else be pushed below the distinct and read every row's date.
    dates = work.materialize(df.select(F.col(date_col).alias("_date")).distinct(), "dates")
    fresh = work.materialize(fresh_only(dates, "_date", reference_time, window_hours), "fresh-dates")
    return df.join(fresh, F.col(date_col) == F.col("_date"), "left_semi")


def freshness_counts(df: DataFrame, date_col: str, reference_time: Column | datetime, window_hours: int = 24) -> DataFrame:
    """Rows kept and skipped by the gate, in one pass."""
    fresh = is_fresh(normalize_date(F.col(date_col), reference_time)["value"], reference_time, window_hours)
    return df.select(fresh.alias("fresh")).agg(
        F.count_if(F.col("fresh")).alias("n_fresh"), F.count_if(~F.col("fresh")).alias("n_stale")
    )


def build_tables(
    startups: DataFrame,
    papers: DataFrame,
    jobs: DataFrame,
    news: DataFrame,
    seeds: DataFrame,
    reference_time: datetime,
    startup_source: str,
    threshold: float = DEFAULT_THRESHOLD,
    window_hours: int = 24,
) -> dict[str, DataFrame]:
    """The six output tables of a batch.

    ``startups`` and ``jobs`` carry a unique ``ordinal``.  The gate comes before the
    resolution, because stale jobs must not register names.  Both tables are resolved
    in one pass, startups first, and a startup's resolution serves its product row too.
    """
    work = Workspace(startups.sparkSession)
    at = utc_moment(reference_time).cast("timestamp")
    fresh_jobs = work.materialize(fresh_by_date(jobs, "date", reference_time, work, window_hours), "fresh-jobs")

    def named(df: DataFrame, rank: int, name: str) -> DataFrame:
        return df.select((F.col("ordinal") + rank * _TABLE_STRIDE).alias("_ordinal"), F.col(name).alias("_raw"))

    rows = named(startups, 0, "entityName").unionByName(named(fresh_jobs, 1, "company"))
    # Only names go through the resolution; whole records are joined once, by ordinal.
    rows = work.materialize(rows, "named")
    resolved = work.materialize(resolve(rows, "_raw", "_ordinal", seeds, threshold), "resolved")
    name = F.col("canonical_name")

    def of(df: DataFrame, rank: int) -> DataFrame:
        own = (F.col("_ordinal") >= rank * _TABLE_STRIDE) & (F.col("_ordinal") < (rank + 1) * _TABLE_STRIDE)
        names = resolved.filter(own).select((F.col("_ordinal") - rank * _TABLE_STRIDE).alias("ordinal"), "canonical_name")
        return df.join(names, "ordinal")

    of_startups, of_jobs = of(startups, 0), of(fresh_jobs, 1)
    source = F.lit(startup_source)
    return {
        "startups": startups_table(of_startups, name, source, at),
        "products": products_table(of_startups, name, source, at),
        "research_papers": papers_table(papers, at),
        "jobs": jobs_table(of_jobs, name, at),
        "news": news_table(fresh_only(news, "published_date", reference_time, window_hours), at),
        "entity_mapping_log": mapping_log(resolved, "_raw"),
    }
