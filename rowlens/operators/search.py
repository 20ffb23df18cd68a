"""Search: literals, ASCII and Turkish folds, regular expressions, cells.

Searches look at the raw line and report every occurrence; the cell search
looks at formatted cells and reports rows. Only the rows of matches leave a
partition; the stored hits are a top-k cut of them and the total is a sum.
"""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowlens.operators.order import sorted_view
from rowlens.spec import HIT_ROWS, PREVIEW_BYTES, SearchSpec

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# The letters that Turkish pairs differently, small and capital.
SMALL, CAPITAL = "iı", "İI"
_RAISED, _LOWERED = str.maketrans(SMALL, CAPITAL), str.maketrans(CAPITAL, SMALL)


def turkish_upper(s: str) -> str:
    return s.translate(_RAISED).upper()


def turkish_lower(s: str) -> str:
    return s.translate(_LOWERED).lower()


def turkish_upper_col(c: Column) -> Column:
    return F.upper(F.translate(c, SMALL, CAPITAL))


def turkish_lower_col(c: Column) -> Column:
    return F.lower(F.translate(c, CAPITAL, SMALL))


#: Spellings of a whole query, and how its first letter is raised where the rest is in Turkish small letters.
WHOLE = (str, str.lower, str.upper, str.capitalize, turkish_lower, turkish_upper)
FIRST = (str.upper, turkish_upper)


def spellings(query: str) -> list[str]:
    """Spellings of a non-ASCII query that a fold by bytes has to try."""
    small = turkish_lower(query)
    tried = {spell(query) for spell in WHOLE} | {raise_(small[:1]) + small[1:] for raise_ in FIRST}
    return sorted(tried - {""})


def _quoted(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


class Pattern:
    """A checked query as column expressions."""

    def __init__(self, spec: SearchSpec):
        self.spec = spec
        self.approximate = not spec.regex and not spec.case and not spec.query.isascii()
        self.folded = not spec.regex and not spec.case and spec.query.isascii()
        if spec.regex:
            try:  # by the engine that will run it
                SparkSession.active()._jvm.java.util.regex.Pattern.compile(self.java)
            except IllegalArgumentException as e:
                raise ValueError(f"not a regular expression: {e}") from None
        self.literals = [] if spec.regex else [spec.query.lower()] if self.folded else spellings(spec.query) if self.approximate else [spec.query]

    def _line(self, raw: Column) -> Column:
        return F.translate(raw, UPPER, LOWER) if self.folded else raw

    @property
    def java(self) -> str:
        """The pattern of one occurrence; literals overlap, so they look ahead."""
        if self.spec.regex:
            return ("(?dm)" if self.spec.case else "(?dmi)") + self.spec.query
        return "(?=" + "|".join(map(_quoted, self.literals)) + ")"

    def matches(self, raw: Column) -> Column:
        if self.spec.regex:
            return raw.rlike(self.java)
        line, found = self._line(raw), None
        for t in self.literals:
            found = F.contains(line, F.lit(t)) if found is None else found | F.contains(line, F.lit(t))
        return found

    def count(self, raw: Column) -> Column:
        return F.regexp_count(self._line(raw), F.lit(self.java)).cast("long")

    def positions(self, raw: Column) -> Column:
        """array<long>: byte offsets of the occurrences in the line."""
        line = self._line(raw)
        long = lambda c: F.octet_length(c).cast("long")

        def places(p: Column) -> Column:
            between, found = p["between"], p["found"]
            # split() makes no empty first part for an empty match at the very start
            gaps = F.when(F.size(between) == F.size(found), F.concat(F.array(F.lit("")), between)).otherwise(between)
            before = F.concat(F.array(F.lit("")), found)
            return running_sums(F.zip_with(F.slice(gaps, 1, F.size(found)), F.slice(before, 1, F.size(found)), lambda gap, match: long(gap) + long(match)))

        parts = F.struct(F.split(line, self.java, -1).alias("between"), F.regexp_extract_all(line, F.lit(self.java), F.lit(0)).alias("found"))
        return _bound(parts, places)


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column, block: int = 32) -> Column:
    """Sums of an array of longs up to each place, by sums of blocks; linear for all but the longest arrays."""
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, n: a + n)

    def sums(xs: Column) -> Column:
        blocks = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
        whole = F.transform(blocks, lambda i: add(F.slice(xs, i * block + 1, block)))
        return _bound(whole, lambda w: F.flatten(F.transform(w, lambda _, i: _bound(add(F.slice(w, 1, i)), lambda base: within(xs, base, i)))))

    def within(xs: Column, base: Column, i: Column) -> Column:
        return _bound(F.slice(xs, i * block + 1, block), lambda part: F.transform(part, lambda _, j: base + add(F.slice(part, 1, j + 1))))

    return _bound(numbers, sums)


def search_rows(rows: DataFrame, spec: SearchSpec, raw: str = "raw") -> DataFrame:
    """The rows with a match."""
    return rows.where(Pattern(spec).matches(F.col(raw)))


def search_counts(rows: DataFrame, spec: SearchSpec, row_no: str = "row_no", raw: str = "raw") -> DataFrame:
    """(row_no, hits) of the rows with a match."""
    p = Pattern(spec)
    return rows.where(p.matches(F.col(raw))).select(F.col(row_no).alias("row_no"), p.count(F.col(raw)).alias("hits"))


def search_total(rows: DataFrame, spec: SearchSpec, raw: str = "raw") -> DataFrame:
    """One row: matching rows and occurrences, without a cap."""
    p = Pattern(spec)
    hits = F.when(p.matches(F.col(raw)), p.count(F.col(raw)))
    return rows.agg(F.count(hits).alias("rows"), F.coalesce(F.sum(hits), F.lit(0)).cast("long").alias("hits"))


def search_positions(rows: DataFrame, spec: SearchSpec, row_no: str = "row_no", raw: str = "raw") -> DataFrame:
    """(row_no, position) of every occurrence, without order or cap; position counts bytes from the line's start."""
    p = Pattern(spec)
    held = rows.where(p.matches(F.col(raw)))
    return held.select(F.col(row_no).alias("row_no"), F.explode(p.positions(F.col(raw))).alias("position"))


def search_hits(rows: DataFrame, spec: SearchSpec, row_no: str = "row_no", raw: str = "raw", start_row: int | None = None, offset: str | None = None, start_offset: int | None = None) -> DataFrame:
    """(hit_no, row_no, position, preview, cut): the first spec.limit occurrences.

    position counts bytes from the line's start. The preview holds the line's
    first bytes, an incomplete character at its end replaced. With offset, the
    column of a line's place in its file, hits also have their own, and begin at
    start_offset. Beyond HIT_ROWS rows are range-sorted and their hits numbered
    by the counts of their partitions.
    """
    p = Pattern(spec)
    held = rows.where(p.matches(F.col(raw)))
    if start_row is not None:
        held = held.where(F.col(row_no) >= start_row)
    size = F.octet_length(raw)
    if start_offset is not None:
        held = held.where(F.col(offset) + size >= start_offset)
    preview = F.make_valid_utf8(F.substring(F.col(raw).cast("binary"), 1, PREVIEW_BYTES).cast("string"))
    shown = F.when(size > PREVIEW_BYTES, preview).otherwise(F.col(raw))
    place = [F.col(offset).alias("_line_offset")] if offset else []
    columns = F.col(row_no).alias("row_no"), p.positions(F.col(raw)).alias("at"), shown.alias("preview"), (size > PREVIEW_BYTES).alias("cut"), *place

    def found(of: DataFrame) -> DataFrame:
        out = of.select("row_no", F.explode("at").alias("position"), "preview", "cut", *(["_line_offset"] if offset else []))
        out = out.withColumn("offset", F.col("_line_offset") + F.col("position")).drop("_line_offset") if offset else out
        return out if start_offset is None else out.where(F.col("offset") >= start_offset)

    if spec.limit > HIT_ROWS:
        dealt = held.repartitionByRange(row_no).sortWithinPartitions(row_no).select(*columns).persist()
        numbered = sorted_view(found(dealt), "hit_no", keep=False).where(F.col("hit_no") < spec.limit)
    else:
        first = found(held.select(*columns)).orderBy("row_no", "position").limit(spec.limit)
        numbered = first.withColumn("hit_no", (F.row_number().over(Window.orderBy("row_no", "position")) - 1).cast("long"))
    return numbered.select("hit_no", "row_no", "position", *(["offset"] if offset else []), "preview", "cut")


def step(hits: int, current: int, forward: bool = True) -> int:
    """The next or previous hit number, around the ends."""
    return (current + (1 if forward else -1)) % hits if hits else -1


def search_cells(rows: DataFrame, query: str, cells: list[str], view_pos: str = "row_no") -> DataFrame:
    """Rows in which a formatted cell contains the query, in view order; none for an empty query."""
    if not query:
        return rows.limit(0)
    found = None
    for c in cells:
        hit = F.contains(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(query))
        found = hit if found is None else found | hit
    return rows.where(found if found is not None else F.lit(False)).orderBy(view_pos)


def safe_in_json(query: str) -> bool:
    """Whether a cell with the query must show it in the record's raw JSON."""
    return query.isprintable() and not set(query) & set('"\\') and not any(w.startswith(query) or query in w for w in ("True", "False"))


def search_store(records: DataFrame, query: str, values: str, raw_json: str, view_pos: str = "view_pos", row_id: str = "row_id") -> DataFrame:
    """(hit_no, view_pos, row_id): records with the query in a formatted value.

    values: array<string>. Where it is safe, the raw JSON is looked at first;
    the answer is the same.
    """
    if not query:
        return records.limit(0).select(F.lit(0).cast("long").alias("hit_no"), F.col(view_pos).alias("view_pos"), F.col(row_id).alias("row_id"))
    held = records.where(F.contains(raw_json, F.lit(query))) if safe_in_json(query) else records
    held = held.where(F.exists(values, lambda v: F.contains(v, F.lit(query))))
    ordered = held.select(F.col(view_pos).alias("view_pos"), F.col(row_id).alias("row_id")).orderBy("view_pos")
    return sorted_view(ordered, "hit_no").select("hit_no", "view_pos", "row_id")
