"""Bank entries, filings and other JSON inputs as relational tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "entry_reference string, transaction_amount struct<currency:string,amount:string>, credit_debit_indicator string, status string, booking_date string, transaction_date string, creditor struct<name:string>, debtor struct<name:string>, creditor_account struct<iban:string>, debtor_account struct<iban:string>, remittance_information array<string>, _corrupt string"


def entries(raw: DataFrame, column: str = "json") -> DataFrame:
    """Booked and unreadable entries; `unreadable` marks rows that miss an amount, a date or valid JSON.

    Debits are negative; the counterparty is the creditor of a debit and the debtor of a credit.
    """
    e = F.from_json(column, ENTRY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = raw.withColumn("e", e).where(F.col("e._corrupt").isNotNull() | (F.col("e.status") == "BOOK") | F.col("e.status").isNull())
    debit = F.col("e.credit_debit_indicator") == "DBIT"
    amount = F.col("e.transaction_amount.amount").try_cast("decimal(14,2)")
    day = F.coalesce(F.col("e.booking_date").try_cast("date"), F.col("e.transaction_date").try_cast("date"))
    bad = F.col("e._corrupt").isNotNull() | amount.isNull() | day.isNull() | ~F.coalesce(F.col("e.credit_debit_indicator").isin("DBIT", "CRDT"), F.lit(False))
    return rows.select(
        *[c for c in raw.columns if c != column],
        F.col("e.entry_reference").alias("entry_reference"),
        day.alias("booking_date"),
        F.when(debit, -amount).otherwise(amount).cast("decimal(14,2)").alias("amount"),
        F.col("e.transaction_amount.currency").alias("currency"),
        F.when(debit, F.col("e.creditor.name")).otherwise(F.col("e.debtor.name")).alias("counterparty_name"),
        F.when(debit, F.col("e.creditor_account.iban")).otherwise(F.col("e.debtor_account.iban")).alias("counterparty_iban"),
        F.array_join("e.remittance_information", "\n").alias("remittance"),
        bad.alias("unreadable"),
    )


def submissions(raw: DataFrame, this_year: int, per_ticker: int = 5, form: str = "10-K") -> DataFrame:
    """Parallel arrays of a filer's submissions to rows: one form, reports of the last five years, newest first."""
    from pyspark.sql import Window

    fields = ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument")
    rows = raw.select("ticker", F.inline(F.arrays_zip(*[F.col(f"filings.recent.{f}").alias(f) for f in fields])))
    kept = rows.where((F.col("form") == form) & (F.year(F.to_date("reportDate")) >= this_year - 5))
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("filingDate"), "accessionNumber"))).where(F.col("n") <= per_ticker)


def manifest(raw: DataFrame, names: DataFrame) -> DataFrame:
    """Filings of a manifest with the company's name, or the ticker where it isn't known."""
    filings = raw.select(F.explode("filings").alias("f")).select("f.*")
    return filings.join(names, "ticker", "left").withColumn("company_name", F.coalesce("company_name", "ticker"))


def guarded(rows: DataFrame, model: str, dimensions: int, vector: str = "embedding") -> DataFrame:
    """Rows of a fixture, each checked as it is read: one of another model or of other dimensions fails the job."""
    told = F.concat(F.lit("a vector of model "), F.coalesce("model", F.lit("none")), F.lit(" and dimensions "), F.coalesce(F.size(vector), F.lit(0)).cast("string"), F.lit(f" where {model} and {dimensions} are asked for"))
    fits = F.coalesce((F.col("model") == model) & (F.size(vector) == dimensions), F.lit(False))
    return rows.withColumn(vector, F.when(fits, F.col(vector)).otherwise(F.raise_error(told).cast(dict(rows.dtypes)[vector])))


def with_ids(rows: DataFrame, ids: DataFrame, key: str, lists: Sequence[str]) -> DataFrame:
    """rows with the keys in their list columns replaced by ids, in order; a key that the map lacks fails the job. ids: key, id."""
    for name in lists:
        each = rows.select(key, F.posexplode(name).alias("__at", "key")).join(ids, "key", "left")
        known = F.coalesce("id", F.raise_error(F.concat(F.lit("unknown key "), F.col("key"))).cast("string"))
        found = each.withColumn("__id", known).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__at", "__id"))).alias("__l"))
        rows = rows.drop(name).join(found, key, "left").withColumn(name, F.coalesce(F.col("__l.__id"), F.array().cast("array<string>"))).drop("__l")
    return rows


def encode_vector(c: Column) -> Column:
    """Base64 of little-endian 32-bit floats."""
    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return F.base64(pack(c))


def decode_vector(c: Column) -> Column:
    @F.pandas_udf("array<float>")
    def unpack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return unpack(F.unbase64(c))


def paged(accounts: DataFrame, key: str, rows: str, fetch: Callable[[int, list, str | None], tuple[list[str], str | None]]) -> DataFrame:
    """key, page, json and error of every account's entries, page by page until no continuation key comes. An account whose
    fetch fails keeps the pages it gave and gets one row with the error (500 characters), and the others go on; raising at the
    end is left to the caller. fetch: (account, the account's column `rows`, continuation key) to entries and the next key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for account, given in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, page, at = [], 0, None
                try:
                    while page == 0 or at:
                        entries, at = fetch(account, given, at)
                        found += [(page, x, None) for x in entries]
                        page += 1
                except Exception as e:
                    found.append((page, None, f"{type(e).__name__}: {e}"[:500]))
                columns = list(zip(*found, strict=True)) if found else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([account] * len(found), pa.int64()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=[key, "page", "json", "error"])

    return accounts.select(F.col(key).cast("long").alias(key), rows).mapInArrow(run, f"{key} long, page int, json string, error string")
