"""From all-text extracts to typed, aligned tables.

Every function is a row-wise projection, so a chain of them is one scan stage and
runs unchanged on a stream. Only ``add_type_flags``, ``add_verified_machine``,
``drop_duplicate_rows`` and ``drop_copies_by_digest`` move rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions import text
from millrace.operators import key_bits
from millrace.sources import schemas

# Identifiers that lose leading zeros when a reader infers numbers.
LEGACY_ID_COLUMNS = ("oid", "operator_rfid")

# Role names by id, and the phone number used on test accounts.
ROLES = {1: "Staff/Engineer", 3: "Operator", 4: "Admin/Manager"}
PLACEHOLDER_PHONE = 9999999999


def _string_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}


def normalise_nulls(df: DataFrame, tokens: Iterable[str] = text.NULL_TOKENS) -> DataFrame:
    tokens = tuple(tokens)
    texts = _string_columns(df)
    return df.select(
        *[text.null_if_token(c, tokens).alias(c) if c in texts else F.col(c) for c in df.columns]
    )


def coerce_booleans(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: text.to_boolean(c) for c in columns if c in df.columns})


def coerce_integers(df: DataFrame, columns: Iterable[str], as_type: str = "bigint") -> DataFrame:
    return df.withColumns({c: text.to_integer(c, as_type) for c in columns if c in df.columns})


def typed(c: Column, target: T.DataType) -> Column:
    """Cast a text cell to a column type; unreadable cells become NULL.

    Dates keep the day as written: the offset in ``2024-07-04 00:00:00+05:30``
    must not move it to the previous day.
    """
    match target:
        case T.BooleanType():
            return text.to_boolean(c)
        case T.ShortType() | T.IntegerType() | T.LongType():
            return text.to_integer(c, target.simpleString())
        case T.DateType():
            return F.when(c.rlike(text.DAY), F.substring(c, 1, 10).try_cast("date"))
        case T.TimestampType():
            return F.when(c.rlike(text.DAY), c.try_cast(target))
        case T.StringType():
            return c.cast("string")
        case T.DoubleType():
            return text.to_double(c)
        case _:
            return c.try_cast(target)


def _source_names(df: DataFrame, aliases: Mapping[str, str] | None) -> dict[str, str]:
    """Target column (lower case) to input column."""
    renamed = {old.lower(): new.lower() for old, new in (aliases or {}).items()}
    return {renamed.get(c.lower(), c.lower()): c for c in df.columns}


def align_columns(
    df: DataFrame, table: str, aliases: Mapping[str, str] | None = None, tokens: Sequence[str] = ()
) -> list[Column]:
    """One expression per table column, in table order.

    ``tokens`` blanks null tokens where they would survive: in text columns. As
    numbers, flags or dates they cannot be read and end up NULL anyway.
    """
    names = _source_names(df, aliases)
    defaults = schemas.DEFAULTS.get(table, {})
    texts = _string_columns(df)
    out = []
    for field in schemas.schema_of(table):
        target = schemas.plain_type(field)
        source = names.get(field.name.lower())
        if source is None:
            cell = F.lit(defaults.get(field.name)).cast(target)
        elif source in texts:
            cell = typed(F.col(f"`{source}`"), target)
            if tokens and isinstance(target, T.StringType):
                cell = text.null_if_token(cell, tokens)
        else:
            cell = F.col(f"`{source}`").try_cast(target)
        out.append(cell.alias(field.name))
    return out


def align(
    df: DataFrame,
    table: str,
    aliases: Mapping[str, str] | None = None,
    legacy_ids: bool = False,
    tokens: Sequence[str] = (),
) -> DataFrame:
    """Project onto a table's columns, order, casing and types.

    Names match ignoring case; columns the input lacks take their default or
    NULL, columns the table lacks are dropped. ``aliases`` renames input columns;
    ``legacy_ids`` strips leading zeros from identifiers.
    """
    aligned = df.select(*align_columns(df, table, aliases, tokens))
    if not legacy_ids:
        return aligned
    bare = {
        c: F.coalesce(text.to_integer(c).cast("string"), F.col(c))
        for c in LEGACY_ID_COLUMNS
        if c in aligned.columns
    }
    return aligned.withColumns(bare)


def drift(df: DataFrame, table: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Columns the input lacks (``missing``) and columns the table lacks (``extra``)."""
    rows = [
        (table, c, status)
        for status, names in zip(("missing", "extra"), drifted(df, table, aliases))
        for c in names.split(",")
        if c
    ]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, status string")


def drifted(df: DataFrame, table: str, aliases: Mapping[str, str] | None = None) -> tuple[str, str]:
    """The same as two lists of names, comma-separated."""
    have = set(_source_names(df, aliases))
    want = {f.name.lower() for f in schemas.schema_of(table)}
    return ",".join(sorted(want - have)), ",".join(sorted(have - want))


def clean_table(
    df: DataFrame, table: str, aliases: Mapping[str, str] | None = None, legacy_ids: bool = False
) -> DataFrame:
    """Null tokens, booleans, integers, dates and alignment in one projection."""
    return align(df, table, aliases, legacy_ids, text.NULL_TOKENS)


def with_rejections(
    df: DataFrame, table: str, aliases: Mapping[str, str] | None = None, surplus: str | None = None
) -> DataFrame:
    """The table's columns, the input row as ``source`` and the offending columns as
    ``rejected`` (comma-separated, empty for a good row).

    A row is rejected when a cell holds text its type cannot read, exceeds the
    declared length, or is missing though required. Unknown boolean spellings
    are NULL by rule and no reason to reject. A line with more cells than the
    header (text in column ``surplus``, see ``readers.read_csv_lines``) is at fault as ``line``.

    Cells are cast once: unnesting a one-element array keeps the optimizer from
    copying the casts into every check and into the filter behind it.
    """
    names = _source_names(df, aliases)
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("source")
    columns = align_columns(df, table, aliases, text.NULL_TOKENS)
    cells = df.select(whole, F.inline(F.array(F.struct(*columns))))
    reasons = []
    for field in schemas.schema_of(table):
        cell = F.col(field.name)
        source = names.get(field.name.lower())
        bad = F.lit(False)
        if source is not None and not isinstance(field.dataType, (T.BooleanType, T.VarcharType)):
            bad = cell.isNull() & text.null_if_token(F.col(f"source.`{source}`").cast("string")).isNotNull()
        if source is not None and isinstance(field.dataType, T.VarcharType):
            bad = F.length(cell) > field.dataType.length
        if not field.nullable:
            bad = bad | cell.isNull()
        reasons.append(F.when(bad, F.lit(field.name)))
    if surplus is not None:
        reasons.append(F.when(F.col(f"source.`{surplus}`").isNotNull(), F.lit("line")))
    return cells.withColumn("rejected", F.concat_ws(",", *reasons))


def decode_letters(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Raw ``t``/``f`` columns to the ``true``/``false`` texts the typed reader takes."""
    return df.withColumns({c: text.flag_letter(c).cast("string") for c in columns if c in df.columns})


def tidy_machine_names(df: DataFrame, column: str = "machine_name") -> DataFrame:
    return df.withColumn(column, text.tidy_name(column))


def type_flags(type_name: Column | str) -> dict[str, Column]:
    """One boolean per machine type."""
    return {
        f"is_{name.lower()}": F.coalesce(text.col(type_name) == name, F.lit(False))
        for name in schemas.MACHINE_TYPES.values()
    }


def add_type_flags(machines: DataFrame, machine_types: DataFrame) -> DataFrame:
    """Type name from ``mtid`` plus the flags; a machine whose type is not known keeps
    its row without a type, for the checks to report. The type table is small by
    nature; the optimizer broadcasts it from its measured size."""
    names = machine_types.select("mtid", "machine_type_name")
    return machines.join(names, "mtid", "left").withColumns(type_flags("machine_type_name"))


def add_verified_machine(facts: DataFrame, machines: DataFrame) -> DataFrame:
    """Machine id and type by name; unknown names keep their row with NULLs.

    Should two machines share a name, the lowest id answers, so no fact row is
    ever multiplied.
    """
    known = (
        machines.where(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.min(F.struct("mid", "machine_type_name", "name")).alias("m"))
        # The name comes out of the struct, so that the join shuffles this small side again:
        # only between two shuffles can adaptive execution split a frequent name.
        .select(F.col("m.name").alias("machine_name"), "m.mid", F.col("m.machine_type_name").alias("machine_type_verified"))
    )
    # The strategy is left to adaptive execution: a side that turns out small is
    # broadcast, and the partitions of a frequent name are split.
    return facts.drop("mid", "machine_type_verified").join(known, "machine_name", "left")


def is_company_email(email: Column | str, domain: str) -> Column:
    address = F.lower(text.col(email))
    return F.coalesce(address.endswith(f"@{domain}") | address.endswith(f".{domain}"), F.lit(False))


def is_test_account(phone: Column | str, company_email: Column | str) -> Column:
    """Default rule; the true one is not documented, so callers may pass their own."""
    placeholder = text.to_integer(phone) == F.lit(PLACEHOLDER_PHONE).cast("bigint")
    return F.coalesce(placeholder, F.lit(False)) | ~text.col(company_email)


def clean_users(
    raw: DataFrame,
    company_domain: str,
    roles: Mapping[int, str] = ROLES,
    test_account: Column | None = None,
) -> DataFrame:
    """Users without credentials: e-mail in lower case, company and test flags, role name."""
    users = decode_letters(normalise_nulls(raw), ("deleted", "active_status"))
    role_names = {str(k): v for k, v in roles.items()}
    users = users.withColumns(
        {
            "email": F.lower("email"),
            "role_name": text.lookup(text.to_integer("roleid").cast("string"), role_names),
            "is_company_email": is_company_email("email", company_domain),
        }
    )
    rule = is_test_account("phno", "is_company_email") if test_account is None else test_account
    return align(users.withColumn("is_test_account", rule), schemas.DIM_USERS)


def user_bucket(deleted: Column | str = "deleted", test: Column | str = "is_test_account") -> Column:
    """Deleted first, then test, then main: every user falls into exactly one bucket."""
    return (
        F.when(text.col(deleted), "deleted").when(text.col(test), "test").otherwise("main")
    )


def drop_duplicate_rows(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Exact duplicates once. Copies collapse map-side before the shuffle, so a
    row repeated billions of times costs one row per task."""
    return df.dropDuplicates(keys) if keys else df.distinct()


def drop_copies_by_digest(df: DataFrame) -> DataFrame:
    """The rows of ``drop_duplicate_rows`` where few of many wide rows are copies.

    64-bit digests are counted first; only rows whose digest may occur twice, by a
    filter of bounded size, are shuffled whole and compared, all others pass as
    they are. The input is read three times: store what is dear to compute or
    does not come out the same each time.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    digests = df.select(F.xxhash64(*columns).alias("digest"))
    repeated = digests.groupBy("digest").count().where("count > 1")
    bits = key_bits.built(repeated, [F.col("digest")])
    marked = key_bits.marked(df, [F.xxhash64(*columns)], bits, "__again")
    single = marked.where("NOT __again").select(*columns)
    return single.unionAll(marked.where("__again").select(*columns).distinct())


def duplicate_report(df: DataFrame) -> DataFrame:
    """Rows before, rows kept and rows removed by ``drop_duplicate_rows``."""
    copies = df.groupBy(*df.columns).count()
    return copies.agg(
        F.sum("count").alias("rows_in"), F.count("*").alias("rows_kept")
    ).withColumn("rows_removed", F.col("rows_in") - F.col("rows_kept"))
