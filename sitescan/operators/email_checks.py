"""Is an address worth writing to? Format, mail domain, probe result."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.emails import email_domain, is_format_valid
from ..functions.text import strip


def one_per_key(table: DataFrame, key: str, **aggregates) -> DataFrame:
    """Merge a lookup table to one row per key, ready to be joined to a side with hot keys.

    Grouping by one column more than needed keeps the join from reusing this
    shuffle. The join then shuffles both sides itself, and only such a join is
    split by adaptive execution where the other side is skewed.
    """
    grouped = table.groupBy(F.xxhash64(key).alias("_hash"), key)
    return grouped.agg(*(a.alias(n) for n, a in aggregates.items())).drop("_hash")


def email_format(emails: DataFrame, column: str = "email") -> DataFrame:
    """Adds format_valid for the trimmed, lower-cased address."""
    return emails.withColumn("email", F.lower(strip(F.col(column)))).withColumn(
        "format_valid", is_format_valid(F.col("email"))
    )


def email_mx(emails: DataFrame, mx_snapshot: DataFrame) -> DataFrame:
    """Adds mx_valid: well-formed, and the domain has a mail server in the snapshot.

    Neither side is forced into a broadcast: the snapshot may name every domain
    there is. Where one domain holds much of the left side, adaptive skew
    handling splits it; the right side has one row per domain.
    """
    per_domain = one_per_key(mx_snapshot, "domain", mx_count=F.max("mx_count"))
    # Rows without a domain get a key of their own, so they do not pile up in one task.
    own = F.concat(F.lit("!"), F.xxhash64(*emails.columns).cast("string"))
    domain = F.when(F.col("format_valid"), email_domain(F.col("email"))).otherwise(own)
    return (
        emails.withColumn("domain", domain)
        .join(per_domain, "domain", "left")
        .withColumn("mx_valid", F.coalesce(F.col("mx_count") > 0, F.lit(False)))
        .drop("domain", "mx_count")
    )


def probe_answers(probes: DataFrame) -> DataFrame:
    """Probe results (email, code) as (email, accepted), one row per address."""
    tidy = probes.withColumn("email", F.lower(strip(F.col("email"))))
    return one_per_key(tidy, "email", accepted=F.max(F.col("code") == 250))


def email_verdict(emails: DataFrame, mx_snapshot: DataFrame, probes: DataFrame | None = None):
    """(email, format_valid, mx_valid, is_valid).

    With probe results (email, code), code 250 decides wherever the domain has
    a mail server.
    """
    checked = email_mx(email_format(emails), mx_snapshot)
    both = F.col("format_valid") & F.col("mx_valid")
    if probes is None:
        verdict = checked.withColumn("is_valid", both)
    else:
        verdict = checked.join(probe_answers(probes), "email", "left").withColumn(
            "is_valid", both & F.coalesce(F.col("accepted"), F.lit(False))
        )
    return verdict.select("email", "format_valid", "mx_valid", "is_valid")


def email_validate_bulk(emails: DataFrame, mx_snapshot: DataFrame, probes: DataFrame | None = None):
    """One verdict per distinct address, however often it occurs."""
    distinct = emails.select(F.lower(strip(F.col("email"))).alias("email")).where(
        F.col("email").isNotNull()
    ).distinct()
    return email_verdict(distinct, mx_snapshot, probes)


def email_valid_backfill(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Sets email_valid on result rows with an address; the others stay NULL.

    An address that fills much of the table can be split; of several verdicts on one a good one counts.
    """
    known = one_per_key(verdicts, "email", _valid=F.max("is_valid")).withColumnRenamed("email", "_email")
    # Rows without an address are spread by their URL, which never equals an address.
    key = F.coalesce(F.lower(strip(F.col("email"))), F.col("url"))
    return (
        rows.drop("email_valid")
        .join(known, key == F.col("_email"), "left")
        .withColumn("email_valid", F.col("_valid"))
        .drop("_email", "_valid")
    )
