"""What a source can be cited by, what a citation names, and what nobody cites.

A text is read once into segments (:func:`segments`): its lines between page or slide markers and headings, found by
running windows over the lines of a source, of which only class and marks are shuffled. All else is made from segments:
units in the order of the text, headings with the part of the text that they span, and time stamps. A locator finds its
heading by equality joins in three tiers, each with a count, so that a name that could mean two headings is told apart.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.settled import settled
from quillon.functions.text import normalize

# Marks of a text and forms of a locator.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
FENCE = r"^ {0,3}(?:```|~~~)"
MARKER = r"(?i)^<!--\s*(page|slide)\s*:\s*([^>]+?)\s*-->$"
HEADING = r"^(#{1,6})\s+(.*?)(?:\s+#+)?\s*$"
STAMP = r"(?<![\d:])(\d{1,2}(?::\d{2}){1,2}(?:[.,]\d{1,3})?)(?![\d:])"
STAMP_VALUE = r"^\d{1,2}(?::\d{2}){1,2}(?:[.,]\d{1,3})?$"
WRAPPER = "## Extracted content"
FORMS = {"page": "page", "slide": "slide", "section": "section", "heading": "section", "sheet": "section", "timestamp": "timestamp"}
#: What may stand before the words of a heading: numbers with dots, a Roman number or a letter, behind a paragraph sign or not.
ENUMERATION = r"^(?:§+ )?(?:[0-9]+(?:\.[0-9]+)*[a-z]?\.?|[ivxlcdm]+\.|[a-z]\))\s+"
LIVE = ("active", "disputed")
LISTED_MARKS, LISTED_UNITS = 10, 20
# End of the fixed values.

WORD = r"[\p{L}\p{N}_]"
DIGITS = [chr(i) for i in range(0x10000) if unicodedata.decimal(chr(i), None) is not None]
PLAIN_DIGITS = "".join(str(unicodedata.decimal(x)) for x in DIGITS)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def number(value: Column) -> Column:
    """A value of decimal digits, of any script, as a number; null for others."""
    return F.when(value.rlike(r"^\p{Nd}+$"), F.translate(value, "".join(DIGITS), PLAIN_DIGITS)).try_cast("long")


def fold(text: Column) -> Column:
    """A heading as compared: without emphasis, case and marks, one space after a paragraph sign, no colon or dot at its end."""
    plain = F.regexp_replace(normalize(F.translate(text, "*`", "")), r"§\s*", "§ ")
    plain = F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))
    return F.rtrim(F.regexp_replace(plain, "[:.]+$", ""))


def bare(folded: Column) -> Column:
    return F.regexp_replace(folded, ENUMERATION, "")


def segments(sources: DataFrame, first_line: int = 1) -> DataFrame:
    """source_no, segment, line, marker_kind, marker_value, heading_no, level, words, has_text, stamps.

    ``sources``: source_no, text (null: empty). Segment 0 is what stands before the first mark; level and words are set
    where a segment begins with a heading. Marks inside a fence are text. A title line followed by the line that the
    registration writes is no part of the source. Texts of one source_no are read as one source each only if the
    number is a key; blank texts have one segment without text.
    """
    whole = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), LINE_END)
    filled = F.slice(F.filter(F.transform(whole, lambda x, i: F.struct(i.alias("i"), strip(x).alias("t"))), lambda x: x.t != ""), 1, 2)
    wrapped = F.get(filled, F.lit(0)).t.startswith("# ") & (F.get(filled, F.lit(1)).t == WRAPPER)
    df = sources.select("source_no", whole.alias("lines"), F.when(wrapped, F.get(filled, F.lit(1)).i + 1).otherwise(0).alias("skip"))
    df = df.select("source_no", "skip", F.posexplode("lines").alias("i", "raw")).where("i >= skip")
    line, raw = F.col("line"), F.col("raw")
    df = df.withColumn("line", strip(raw))
    words = strip(F.regexp_extract(line, HEADING, 2))
    heads = line.startswith("#") & words.rlike(WORD)
    stamped = lambda x: F.when(x.contains(":"), F.regexp_extract_all(x, F.lit(STAMP), F.lit(1))).otherwise(F.array().cast("array<string>"))
    df = df.select(
        "source_no", "i", raw.rlike(FENCE).alias("fence"), F.when(line.startswith("<!--"), F.nullif(F.lower(F.regexp_extract(line, MARKER, 1)), F.lit(""))).alias("kind"),
        F.regexp_extract(line, MARKER, 2).alias("value"), F.when(heads, F.length(F.regexp_extract(line, HEADING, 1))).alias("level"), F.when(heads, words).alias("words"),
        line.rlike(WORD).alias("says"), stamped(line).alias("stamps"))
    order = Window.partitionBy("source_no").orderBy("i")
    outside = ~F.col("fence") & (F.coalesce(F.sum(F.col("fence").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 0)
    df = df.withColumn("outside", outside)
    for c in ("kind", "level"):
        df = df.withColumn(c, F.when(F.col("outside"), F.col(c)))
    df = df.withColumn("level", F.when(F.col("kind").isNull(), F.col("level")))
    begins = F.col("kind").isNotNull() | F.col("level").isNotNull()
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({
        "begins": begins, "segment": F.sum(begins.cast("long")).over(so_far), "heading_no": F.sum(F.col("level").isNotNull().cast("long")).over(so_far),
        "marker": F.last(F.when(F.col("kind").isNotNull(), F.struct("kind", "value")), ignorenulls=True).over(so_far),
    })
    told = F.col("fence") | (~F.col("begins") & F.col("says"))
    heard = F.when(F.col("kind").isNull() & ~F.col("fence"), F.when(F.col("level").isNotNull(), stamped(F.col("words"))).otherwise(F.col("stamps")))
    out = df.groupBy("source_no", "segment").agg(
        (F.min("i") + first_line).cast("long").alias("line"), F.first("marker").alias("marker"), F.max("heading_no").alias("heading_no"), F.max("level").cast("long").alias("level"),
        F.max(F.when(F.col("level").isNotNull(), F.col("words"))).alias("words"), F.bool_or(told).alias("has_text"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(heard)))).alias("stamps"),
    )
    return out.select("source_no", "segment", "line", F.col("marker.kind").alias("marker_kind"), F.col("marker.value").alias("marker_value"), "heading_no", "level", "words", "has_text", "stamps")


def unit_kinds(parts: DataFrame) -> DataFrame:
    """source_no, unit_kind: what a source is cited by."""
    kind = F.when(F.bool_or(F.col("marker_kind") == "page"), "page").when(F.count("marker_kind") > 0, "slide").when(F.count("level") > 0, "section").when(F.bool_or("has_text"), "document").otherwise("empty")
    return parts.groupBy("source_no").agg(kind.alias("unit_kind"))


def labelled(parts: DataFrame) -> DataFrame:
    """Segments with unit_kind, until (the heading at which the section of their heading ends) and unit (null: none)."""
    source = Window.partitionBy("source_no")
    order = source.orderBy("segment")
    behind = order.rowsBetween(1, Window.unboundedFollowing)
    df = parts.withColumns({f"next_{k}": F.first(F.when(F.col("level") == k, F.col("heading_no")), ignorenulls=True).over(behind) for k in range(1, 7)})
    nearest = F.least(*(F.when(F.col("level") >= k, F.col(f"next_{k}")) for k in range(1, 7)))
    ends = F.coalesce(nearest, F.max("heading_no").over(source) + 1)
    df = df.withColumn("own_until", F.when(F.col("level").isNotNull(), ends))
    same = F.count("words").over(Window.partitionBy("source_no", "words"))
    df = df.withColumn("named", F.when(F.col("level").isNotNull(), F.struct(F.col("own_until").alias("until"), F.concat(F.lit("section="), "words", F.when(same > 1, F.concat(F.lit(" (line "), "line", F.lit(")"))).otherwise("")).alias("label"))))
    df = df.withColumn("named", F.last("named", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.join(unit_kinds(parts), "source_no").withColumn("until", F.col("named.until"))
    kind = F.col("unit_kind")
    unit = F.when(kind.isin("page", "slide"), F.concat("marker_kind", F.lit("="), "marker_value")).when(kind == "section", F.col("named.label")).when(kind == "document", F.lit("document"))
    df = df.withColumn("unit", F.when(F.col("has_text"), unit))
    # a title that spans all other sections is no unit; of a chain of such titles, one after the other
    counts = F.col("unit").isNotNull() & (kind == "section")
    spans = (F.col("until") > F.max(F.when(counts, F.col("heading_no"))).over(source)) & (F.count(F.when(counts, 1)).over(order) < F.count(F.when(counts, 1)).over(source))
    df = df.withColumn("spans", F.when(counts, spans))
    chain = F.coalesce(F.min(F.col("spans").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1, F.lit(False))
    df = df.withColumn("unit", F.when(~(counts & chain), F.col("unit")))
    return df.select("source_no", "unit_kind", "segment", "line", "marker_kind", "marker_value", "heading_no", "level", "words", "until", "unit", "has_text", "stamps")


def units_of(marked: DataFrame) -> DataFrame:
    rows = marked.where("unit IS NOT NULL").groupBy("source_no", F.col("unit_kind").alias("kind"), "unit").agg(F.min("segment").alias("first"))
    order = F.row_number().over(Window.partitionBy("source_no").orderBy("first")).cast("long")
    return rows.select("source_no", order.alias("ord"), "unit", "kind")


def source_units(parts: DataFrame) -> DataFrame:
    """source_no, ord, unit, kind: units of each source, in the order of the text. ``parts``: :func:`segments`."""
    return units_of(labelled(parts))


def source_headings(parts: DataFrame) -> DataFrame:
    """source_no, heading_no, until, level, line, words, folded, bare. ``parts``: :func:`segments` or :func:`labelled`."""
    marked = parts if "until" in parts.columns else labelled(parts)
    rows = marked.where("level IS NOT NULL").select("source_no", "heading_no", "until", "level", "line", "words", fold(F.col("words")).alias("folded"))
    return rows.withColumn("bare", bare(F.col("folded")))


def stamps_of(marked: DataFrame) -> DataFrame:
    """source_no, stamp, unit ('': in no unit)."""
    return marked.select("source_no", F.coalesce("unit", F.lit("")).alias("unit"), F.explode("stamps").alias("stamp")).distinct()


def source_markers(parts: DataFrame) -> DataFrame:
    """source_no, kind, value, n (a decimal value as a number), ord."""
    rows = parts.where("marker_kind IS NOT NULL").groupBy("source_no", F.col("marker_kind").alias("kind"), F.col("marker_value").alias("value")).agg(F.min("segment").alias("ord"))
    return rows.withColumn("n", number(F.col("value")))


def in_runs(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with ``run``: neighbours by ``order`` whose number n is one more than the last share a run."""
    w = Window.partitionBy(*keys).orderBy(order)
    follows = F.coalesce(F.col("n") == F.lag("n").over(w) + 1, F.lit(False))
    return rows.withColumn("run", F.sum((~follows).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def marker_lists(markers: DataFrame) -> DataFrame:
    """source_no, kind, said: the values of a source's markers, runs of numbers as ranges, ten of them and how many more."""
    runs = in_runs(markers, ["source_no", "kind"], "ord").groupBy("source_no", "kind", "run").agg(F.min_by("value", "ord").alias("a"), F.max_by("value", "ord").alias("b"), F.count("*").alias("size"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("run", F.when(F.col("size") == 1, F.col("a")).otherwise(F.concat("a", F.lit("-"), "b")).alias("x")))), lambda x: x.x)
    more = F.when(F.size("items") > LISTED_MARKS, F.concat(F.lit(" and "), F.size("items") - LISTED_MARKS, F.lit(" more"))).otherwise("")
    return runs.groupBy("source_no", "kind").agg(items.alias("items")).select("source_no", "kind", F.concat(F.array_join(F.slice("items", 1, LISTED_MARKS), ", "), more).alias("said"))


def parse_locators(citations: DataFrame) -> DataFrame:
    """source_no, locator, form, key, value, low, high of each distinct pair. form: page, slide, section, timestamp, document or unchecked."""
    text = strip(F.col("locator"))
    key = F.lower(F.regexp_extract(text, r"^([A-Za-z]+)\s*=\s*(.*)$", 1))
    known = F.create_map(*(F.lit(x) for kv in FORMS.items() for x in kv))
    form = F.when(F.lower(text) == "document", "document").otherwise(F.coalesce(F.try_element_at(known, key), F.lit("unchecked")))
    value = strip(F.regexp_extract(text, r"^([A-Za-z]+)\s*=\s*(.*)$", 2))
    df = citations.select("source_no", F.coalesce("locator", F.lit("")).alias("locator")).distinct().select("source_no", "locator", form.alias("form"), key.alias("key"), value.alias("value"))
    df = df.withColumn("value", F.when(F.col("form").isin("document", "unchecked"), "").otherwise(F.col("value")))
    counted, span = F.col("form").isin("page", "slide"), r"^(\p{Nd}+)\s*[-–—]\s*(\p{Nd}+)$"
    one = number(F.col("value"))
    return df.withColumns({"low": F.when(counted, F.coalesce(one, number(F.regexp_extract("value", span, 1)))), "high": F.when(counted, F.coalesce(one, number(F.regexp_extract("value", span, 2))))})


KEYS = ["source_no", "locator"]


def _by_marker(asked: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_no, locator, state, reason) of page and slide locators, and (source_no, locator, unit) that they name."""
    asked = asked.where("form IN ('page', 'slide')").withColumnRenamed("form", "kind")
    spot = ["source_no", "kind"]
    there = lambda c: markers.where("n IS NOT NULL").select(*spot, F.col("n").alias(c)).distinct().withColumn(f"has_{c}", F.lit(True))
    spelled = markers.select(*spot, F.lower("value").alias("lowered")).distinct().withColumn("has_value", F.lit(True))
    df = asked.withColumn("lowered", F.lower("value")).join(marker_lists(markers), spot, "left").join(there("low"), [*spot, "low"], "left").join(there("high"), [*spot, "high"], "left").join(spelled, [*spot, "lowered"], "left")
    mode = F.when(F.col("said").isNull() | (F.col("value") == ""), None).when(F.col("low") > F.col("high"), None).when(F.col("has_low") & F.col("has_high"), "range").when(F.col("has_value"), "value")
    kind, value = F.col("kind"), F.col("value")
    lead = F.regexp_extract(value, r"^(\p{Nd}+)(?U:\b)\s*\S", 1)
    reason = (
        F.when(value == "", F.concat(F.lit("the locator names no "), "key")).when(F.col("said").isNull(), F.concat(F.lit("the extraction has no "), kind, F.lit(" markers")))
        .when(F.col("low") > F.col("high"), F.concat(F.lit("the range "), value, F.lit(" is reversed; write "), kind, F.lit("="), "high", F.lit("-"), "low"))
        .when(F.col("low").isNull() & value.rlike(r"^\p{Nd}+\s*[,;]\s*\p{Nd}+"), F.concat(F.lit("write one entry per "), kind, F.lit(", or a range such as "), kind, F.lit("=3-5")))
        .when(F.col("low").isNull() & (lead != ""), F.concat(F.lit("'"), value, F.lit("' is not a "), kind, F.lit(" marker value; write "), kind, F.lit("="), lead, F.lit(" and keep further detail in the claim text")))
        .otherwise(F.concat(F.lit("the extraction marks "), kind, F.lit("s "), "said"))
    )
    df = df.withColumn("mode", mode).withColumn("reason", F.when(F.col("mode").isNull(), reason).otherwise(""))
    unit = F.concat("kind", F.lit("="), "value")
    own = markers.select(*spot, F.lower("value").alias("lowered"), "n", unit.alias("unit"))
    ranged = df.where("mode = 'range'").select(*KEYS, "kind", "low", "high").join(own.drop("lowered"), spot).where("n BETWEEN low AND high")
    valued = df.where("mode = 'value'").select(*KEYS, "kind", "lowered").join(own.drop("n"), [*spot, "lowered"])
    named = ranged.select(*KEYS, "unit").unionByName(valued.select(*KEYS, "unit"))
    return df.select(*KEYS, F.when(F.col("mode").isNull(), "unresolved").otherwise("resolved").alias("state"), "reason"), named


def _by_heading(asked: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of locators by heading: exact, then without enumeration, then as the beginning of one heading."""
    asked = asked.where("form = 'section'").withColumn("target", fold(F.col("value")))
    headings = source_headings(marked).select("source_no", "heading_no", "until", "folded", "bare")
    plain = headings.where("bare <> folded")
    first = lambda c: F.regexp_extract(c, r"^(\S+)", 1)
    begins = headings.select("source_no", "heading_no", "until", F.explode(F.array_distinct(F.array("folded", "bare"))).alias("said"))
    begins = begins.withColumn("word", first("said"))
    ask = asked.where("target <> ''").select(*KEYS, "target")
    one = ask.join(headings.withColumnRenamed("folded", "target"), ["source_no", "target"]).select(*KEYS, F.lit(1).alias("tier"), "heading_no", "until")
    two = ask.join(plain.withColumnRenamed("bare", "target"), ["source_no", "target"]).select(*KEYS, F.lit(2).alias("tier"), "heading_no", "until")
    three = ask.withColumn("word", first("target")).join(begins, ["source_no", "word"]).where(F.col("said").startswith(F.concat("target", F.lit(" ")))).select(*KEYS, F.lit(3).alias("tier"), "heading_no", "until").distinct()
    hits = one.unionByName(two).unionByName(three)
    best = hits.groupBy(*KEYS, "tier").agg(F.count("*").alias("n")).groupBy(*KEYS).agg(F.min(F.struct("tier", "n")).alias("best")).select(*KEYS, "best.*")
    told = asked.join(best, KEYS, "left")
    bad = F.when(F.col("tier").isNull() | ((F.col("tier") > 1) & (F.col("n") > 1)), True).otherwise(False)
    said = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    value = F.col("value")
    reason = F.when(F.col("target") == "", said("the locator names no ", F.col("key"))).when(F.col("tier").isNull(), said("no heading of the extraction matches '", value, "'"))
    reason = reason.when(F.col("tier") == 2, said(F.col("n").cast("string"), " headings match '", value, "'; cite the full heading with its number")).otherwise(said(F.col("n").cast("string"), " headings begin with '", value, "'; cite the full heading"))
    told = told.withColumn("bad", bad)
    states = told.select(*KEYS, F.when(F.col("bad"), "unresolved").otherwise("resolved").alias("state"), F.when(F.col("bad"), reason).otherwise("").alias("reason"))
    chosen = told.where(~F.col("bad")).select(*KEYS, "tier").join(hits, [*KEYS, "tier"]).select(*KEYS, F.col("heading_no").alias("begin"), "until")
    spanned = marked.where("unit IS NOT NULL").select("source_no", "heading_no", "unit").distinct()
    named = chosen.join(spanned, "source_no").where("heading_no >= begin AND heading_no < until").select(*KEYS, "unit")
    return states, named


def _by_stamp(asked: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of time stamps."""
    asked = asked.where("form = 'timestamp'").withColumn("stamp", F.btrim("value", F.lit("[]() ")))
    found = stamps_of(marked)
    met = asked.join(found.select("source_no", "stamp").distinct().withColumn("met", F.lit(True)), ["source_no", "stamp"], "left").withColumn("met", F.coalesce("met", F.lit(False)))
    reason = F.when(F.col("met"), "").when(F.col("value") == "", F.concat(F.lit("the locator names no "), "key")).when(F.col("stamp").rlike(STAMP_VALUE), F.concat(F.lit("the extraction does not contain the time stamp '"), "stamp", F.lit("'")))
    reason = reason.otherwise(F.concat(F.lit("'"), "value", F.lit("' is not a time stamp such as 00:12:30 or 12:30")))
    states = met.select(*KEYS, F.when(F.col("met"), "resolved").otherwise("unresolved").alias("state"), reason.alias("reason"))
    return states, met.where("met").join(found.where("unit <> ''"), ["source_no", "stamp"]).select(*KEYS, "unit")


class Evidence:
    """Citations resolved against sources: three small tables that every report below reads.

    ``citations``: source_no, locator and, for reports on claims, claim_id and claim_status; ``parts``: :func:`segments`.
    ``units``: source_no, ord, unit, kind. ``states``: source_no, locator, form, state, reason, n_units, broad, once for
    each distinct locator; other spellings than the known forms are unchecked, those into a source that is not
    there have state unknown-source. ``named``: source_no, locator, unit. A resolved locator may name no unit (a
    title, a stamp before the first page); broad: it names all units of a source that has two or more.
    """

    def __init__(self, citations: DataFrame, parts: DataFrame):
        self.citations = citations.withColumn("locator", F.coalesce("locator", F.lit("")))
        marked = settled(labelled(parts))
        self.sources = marked.select("source_no").distinct()
        self.units = units_of(marked)
        asked = settled(parse_locators(self.citations).join(self.sources.withColumn("there", F.lit(True)), "source_no", "left"))
        known = asked.where("there").drop("there")
        whole = known.where("form = 'document'").select(KEYS).join(self.units.select("source_no", "unit"), "source_no").select(*KEYS, "unit")
        told = [_by_marker(known, source_markers(marked)), _by_heading(known, marked), _by_stamp(known, marked)]
        plain = F.when(F.col("there").isNull(), "unknown-source").when(F.col("form") == "document", "resolved").otherwise("unchecked")
        rest = asked.where("there IS NULL OR form IN ('document', 'unchecked')").select(*KEYS, plain.alias("state"), F.lit("").alias("reason"))
        named = reduce(DataFrame.unionByName, [whole, *(x for _, x in told)]).distinct()
        self.named = settled(named.join(self.units.select("source_no", "unit"), ["source_no", "unit"], "left_semi").select(*KEYS, "unit"))
        states = reduce(DataFrame.unionByName, [rest, *(x for x, _ in told)])
        n = self.named.groupBy(*KEYS).agg(F.count("*").alias("n_units"))
        total = self.units.groupBy("source_no").agg(F.count("*").alias("total"))
        states = asked.select(*KEYS, "form").join(states, KEYS).join(n, KEYS, "left").join(total, "source_no", "left").na.fill(0, ["n_units", "total"])
        broad = (F.col("state") == "resolved") & (F.col("total") > 1) & (F.col("n_units") == F.col("total"))
        self.states = settled(states.select(*KEYS, "form", "state", "reason", "n_units", broad.alias("broad")))

    def resolved(self) -> DataFrame:
        """claim_id, claim_status, source_no, locator, state, reason, n_units, broad: what each citation names."""
        return self.citations.join(self.states.drop("form"), KEYS)

    def cited(self) -> DataFrame:
        """source_no, unit: units that live claims cite by a locator that is not broad."""
        narrow = self.resolved().where(F.col("claim_status").isin(*LIVE)).where("state = 'resolved' AND NOT broad").select(KEYS).distinct()
        return self.named.join(narrow, KEYS, "left_semi").select("source_no", "unit").distinct()


def locator_resolve(evidence: Evidence) -> DataFrame:
    """claim_id, source_no, locator, state, reason, n_units, broad."""
    return evidence.resolved().select("claim_id", "source_no", "locator", "state", "reason", "n_units", "broad")


def source_coverage(evidence: Evidence) -> DataFrame:
    """source_no, total, cited, citations, broad, unchecked of each source: its units, those cited, and the citations of live claims."""
    told = evidence.resolved().where(F.col("claim_status").isin(*LIVE)).where("state <> 'unknown-source'")
    told = told.groupBy("source_no").agg(F.count("*").alias("citations"), F.count_if("broad").alias("broad"), F.count_if(F.col("state") == "unchecked").alias("unchecked"))
    units = evidence.units.join(evidence.cited().withColumn("hit", F.lit(1)), ["source_no", "unit"], "left").groupBy("source_no").agg(F.count("*").alias("total"), F.count("hit").alias("cited"))
    return evidence.sources.join(units, "source_no", "left").join(told, "source_no", "left").na.fill(0).select("source_no", "total", "cited", "citations", "broad", "unchecked")


def uncited_runs(evidence: Evidence) -> DataFrame:
    """source_no, ord, label, size, listed: units that nobody cites, in order; neighbouring pages or slides of consecutive numbers as one. listed: among the first twenty."""
    left = evidence.units.join(evidence.cited(), ["source_no", "unit"], "left_anti")
    value = F.regexp_extract("unit", "^(?:page|slide)=(.*)$", 1)
    left = left.withColumns({"mark": F.split("unit", "=")[0], "n": F.when(F.col("kind").isin("page", "slide"), number(value)), "value": value})
    w = Window.partitionBy("source_no").orderBy("ord")
    follows = F.coalesce((F.col("n") == F.lag("n").over(w) + 1) & (F.col("mark") == F.lag("mark").over(w)), F.lit(False))
    left = left.withColumn("run", F.sum((~follows).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = left.groupBy("source_no", "run").agg(F.min_by("unit", "ord").alias("a"), F.max_by("value", "ord").alias("b"), F.count("*").alias("size"))
    label = F.when(F.col("size") == 1, F.col("a")).otherwise(F.concat("a", F.lit("-"), "b"))
    return runs.select("source_no", F.col("run").alias("ord"), label.alias("label"), "size", (F.col("run") <= LISTED_UNITS).alias("listed"))
