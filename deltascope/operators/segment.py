"""Filing documents to text, sections and tables."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import markup

BLOCKS = frozenset("address article aside blockquote div dl dt dd fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
HIDDEN = frozenset(("script", "style", "head", "ix:header", "noscript"))
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Reader(markup.Reader):
    """Text by blocks; ``tables`` takes tables out of the text as header and rows."""

    def __init__(self, tables: bool):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip: list[str] = []
        self.want_tables, self.tables, self.row, self.cell, self.depth = tables, [], None, None, 0

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag not in EMPTY:
                self.skip.append(tag)
            return
        style = (dict(attrs).get("style") or "").lower().replace(" ", "") if attrs else ""
        if tag in HIDDEN or "display:none" in style:
            if tag not in EMPTY:
                self.skip.append(tag)
            return
        if self.want_tables and tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
                self.parts.append("\n[TABLE]\n")
        elif self.want_tables and self.depth and tag == "tr":
            self.row = []
            self.tables[-1].append(self.row)
        elif self.want_tables and self.depth and tag in ("td", "th") and self.row is not None:
            self.row.append("")
        elif tag == "br" or tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        if self.want_tables and tag == "table" and self.depth:
            self.depth -= 1
        elif tag in ("td", "th"):
            self.parts.append(" ")
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.skip:
            return
        if self.want_tables and self.depth:
            if self.row:
                self.row[-1] = " ".join((self.row[-1] + " " + data).split())
        else:
            self.parts.append(data)


def _read(page: str, tables: bool) -> tuple[str, list[list[list[str]]]]:
    reader = _Reader(tables)
    reader.read(page)
    lines = [re.sub(r"[ \t\r\f\v\xa0]+", " ", x).strip() for x in "".join(reader.parts).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip(), reader.tables


def html_to_text(page: str | None) -> str:
    """Blocks become lines; hidden parts, scripts and styles go; runs of blank lines become one."""
    return _read(page or "", False)[0]


def html_with_tables(page: str | None) -> tuple[str, list[dict]]:
    """Text with ``[TABLE]`` marks in compatibility form with plain quotes and dashes, page numbers and rules dropped, and the
    tables as headers and rows."""
    text, raw = _read(page or "", True)
    text = unicodedata.normalize("NFKC", text).translate(PLAIN)
    text = "\n".join(x for x in text.split("\n") if not PAGING.fullmatch(x))
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    return text, [{"headers": t[0], "rows": t[1:]} for t in raw if t]


#: Page numbers, lines of contents and rules.
PAGING = re.compile(r"(?:page )?-?\s*\d{1,4}\s*-?|.*\.{4,}\s*\d{1,4}|[.\-_= ]{3,}.*", re.I)
#: Quotes and dashes, plain.
PLAIN = str.maketrans(dict(zip("‘’‚‛“”„‐‑‒–—―", "''''\"\"\"------")) | {"•": "*", "®": "(R)", "©": "(c)"})

# What the sections of annual and quarterly forms are called: place -> (key, label, title), in order.
ANNUAL = {"1A": ("risk_factors", "Item 1A", "Risk Factors"), "7": ("mdna", "Item 7", "Management's Discussion and Analysis"), "7A": ("market_risk", "Item 7A", "Market Risk"), "8": ("financial_statements", "Item 8", "Financial Statements"), "15": ("exhibits", "Item 15", "Financial Statements")}
QUARTERLY = {"II/1A": ("risk_factors", "Part II, Item 1A", "Risk Factors"), "I/2": ("mdna", "Part I, Item 2", "Management's Discussion and Analysis"), "I/3": ("market_risk", "Part I, Item 3", "Market Risk"), "I/1": ("financial_statements", "Part I, Item 1", "Financial Statements")}
#: A word of each heading of the public quarterly form that no other heading of that item number has.
QUARTERLY_WORDS = {"I/1": "financial", "I/2": "management", "I/3": "market", "I/4": "controls", "II/1": "legal", "II/1A": "risk", "II/2": "unregistered", "II/3": "defaults", "II/4": "mine", "II/5": "other", "II/6": "exhibits"}
ORDER = ("risk_factors", "mdna", "market_risk", "financial_statements")
# The item titles of the public annual form, by number.
TITLES = {
    "1": "Business", "1A": "Risk Factors", "1B": "Unresolved Staff Comments", "2": "Properties", "3": "Legal Proceedings", "4": "Mine Safety Disclosures",
    "5": "Market for Registrant's Common Equity, Related Stockholder Matters and Issuer Purchases of Equity Securities", "6": "Selected Financial Data",
    "7": "Management's Discussion and Analysis of Financial Condition and Results of Operations", "7A": "Quantitative and Qualitative Disclosures About Market Risk",
    "8": "Financial Statements and Supplementary Data", "9": "Changes in and Disagreements With Accountants on Accounting and Financial Disclosure", "9A": "Controls and Procedures", "9B": "Other Information",
    "10": "Directors, Executive Officers and Corporate Governance", "11": "Executive Compensation",
    "12": "Security Ownership of Certain Beneficial Owners and Management and Related Stockholder Matters", "13": "Certain Relationships and Related Transactions, and Director Independence",
    "14": "Principal Accountant Fees and Services", "15": "Exhibits and Financial Statement Schedules",
}


def heading_pattern(number: str, title: str, within: int = 80) -> str:
    """Matches ``item``, the number and, at most ``within`` characters on, one of the first two distinctive words of the title
    (nine letters of it are enough) in a lower-case line."""
    told = [w for w in re.findall("[a-z]+", title.lower()) if len(w) > 3 and w not in ("with", "about", "other")]
    return rf"\bitem\s+{number.lower()}(?![0-9a-z]).{{0,{within}}}?\b(?:{'|'.join(w[:9] for w in told[:2])})"


#: Patterns of named headings by the name of their section.
NAMED = {f"item_{number.lower()}": heading_pattern(number, title) for number, title in TITLES.items()}
ITEM_LINE = r"(?i)^item (\d{1,2}[a-c]?)(?:[ .:\-–—]+([^\d .:\-–—].*)?)?$"
PART_LINE = r"(?i)^part (iv|iii|ii|i)(?:[ .,:\-\u2013\u2014].{0,100})?$"
RUNNING_LINE = r"(?i)^(?:part [ivx]+\.?|item \d{1,2}[a-c]?\.?|(?:page )?\d{1,3})$"
_DOC = ("doc", "form")


def _in_order() -> WindowSpec:
    return Window.partitionBy(*_DOC).orderBy("no")


def marked_lines(filings: DataFrame) -> DataFrame:
    """(doc, form, no, line, item, title, part, running) of every line of ``filings`` (doc, form, text): the item or part
    that it heads, null if none, and whether it only repeats at the top or foot of pages."""
    raw = filings.where("text is not null").select("doc", "form", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    tidy = raw.withColumn("line", F.trim(F.regexp_replace("line", "[ \\t\\r\u00a0]+", " ")))
    head = lambda pattern, group: F.nullif(F.regexp_extract("line", pattern, group), F.lit(""))
    return tidy.select("doc", "form", "no", "line", F.upper(head(ITEM_LINE, 1)).alias("item"), F.coalesce(head(ITEM_LINE, 2), F.lit("")).alias("title"), F.upper(head(PART_LINE, 1)).alias("part"), F.col("line").rlike(RUNNING_LINE).alias("running"))


def _joined(lines: DataFrame, *by: str) -> DataFrame:
    """The text of each section from its lines."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n")
    out = lines.groupBy(*_DOC, *by).agg(text.alias("text"))
    return out.withColumn("text", F.regexp_replace(F.regexp_replace("text", "\n{3,}", "\n\n"), "^[ \n]+|[ \n]+$", ""))


def _named_places(table: dict[str, tuple]) -> Column:
    pairs = [x for place, values in table.items() for x in (F.lit(place), F.struct(*[F.lit(v).alias(n) for v, n in zip(values, ("key", "item", "title"))]))]
    return F.try_element_at(F.create_map(*pairs), F.col("place"))


def target_sections(filings: DataFrame, least: int = 60, short: int = 1000) -> DataFrame:
    """(doc, form, key, item, title, text, char_count) of the wanted sections of annual and quarterly ``filings`` (doc, form,
    text), amendments included; other forms and null texts have none.

    One window a document tells each line the section that it lies in. The longest text found for a key stays (of equal
    ones the first), so tables of contents lose; sections under ``least`` characters are left out. Lines that run along
    with the pages neither open sections nor stay in them. Quarterly headings belong to the part that their title
    names, else to the last one seen. Statements shorter than ``short`` refer to the exhibits, whose longer text stands in.
    """
    base = F.regexp_replace(F.upper("form"), "/A$", "")
    own = marked_lines(filings.where(base.startswith("10-K") | base.startswith("10-Q")))
    quarterly = F.upper("form").startswith("10-Q")
    seen, before = _in_order(), _in_order().rowsBetween(Window.unboundedPreceding, -1)
    titled = F.lit(None).cast("string")
    for place, word in QUARTERLY_WORDS.items():
        part, item = place.split("/")
        titled = F.when((F.col("item") == item) & F.lower("title").contains(word), part).otherwise(titled)
    part = F.coalesce(titled, F.last("part", True).over(seen), F.lit(""))
    own = own.withColumn("place", F.when(F.col("item").isNotNull(), F.when(quarterly, F.concat_ws("/", part, F.col("item"))).otherwise(F.col("item"))))
    fresh = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.last(c, True).over(before))
    own = own.withColumn("opens", fresh("place") | fresh("part"))
    own = own.withColumn("section", F.last(F.when(F.col("opens"), F.col("no")), True).over(seen)).withColumn("place", F.last(F.when(F.col("opens"), F.coalesce("place", F.lit(""))), True).over(seen))
    texts = _joined(own.where("no > section and not running and place <> ''"), "section", "place")
    named = texts.withColumn("is", F.when(quarterly, _named_places(QUARTERLY)).otherwise(_named_places(ANNUAL))).where("is is not null")
    best = named.groupBy(*_DOC, F.col("is.key").alias("key")).agg(F.max_by(F.struct("is.item", "is.title", "text"), F.struct(F.length("text"), -F.col("section"))).alias("b"))
    found = best.groupBy(*_DOC).agg(F.map_from_entries(F.collect_list(F.struct("key", "b"))).alias("m"))  # five keys at most
    stated, spare = F.try_element_at("m", F.lit("financial_statements")), F.try_element_at("m", F.lit("exhibits"))
    refers = F.coalesce(F.length(spare["text"]) > F.coalesce(F.length(stated["text"]), F.lit(0)), F.lit(False)) & (F.coalesce(F.length(stated["text"]), F.lit(0)) < short)
    stands_in = F.struct(F.lit("Item 15 (referenced from Item 8)").alias("item"), F.lit("Financial Statements").alias("title"), spare["text"].alias("text"))
    chosen = F.array(*[F.struct(F.lit(k).alias("key"), (F.when(refers, stands_in).otherwise(stated) if k == "financial_statements" else F.try_element_at("m", F.lit(k))).alias("b")) for k in ORDER])
    return (found.select(*_DOC, F.inline(chosen)).where(F.length("b.text") >= least)
            .select(*_DOC, "key", "b.item", "b.title", "b.text", F.length("b.text").alias("char_count")))


def item_sections(filings: DataFrame, keep: str = "every", least: int = 0, clip: int | None = None) -> DataFrame:
    """(doc, form, key, label, title, text) of every item heading of ``filings``, whatever the form.

    ``key`` is the item, in quarterly forms with its part (``P2I1A``); the label joins item and title. ``keep``: every
    heading, the ``longest`` text of a key (of equal ones the first), or the ``last``; texts of ``least`` characters or
    fewer do not count. A text without headings is one section 0 titled by its first line. ``clip`` cuts the texts.
    """
    # each text is cut within its own row, since its lines are there in order: nothing but the result ever leaves the row.
    # What a lambda reads more than once is a column of its own, so that Spark does not make it anew for each element.
    head = lambda x, pattern, group: F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))
    mark = lambda x, no: F.struct(no.alias("no"), F.upper(head(x, ITEM_LINE, 1)).alias("item"), F.coalesce(head(x, ITEM_LINE, 2), F.lit("")).alias("title"), F.upper(head(x, PART_LINE, 1)).alias("part"))
    own = filings.where("text is not null").select(*_DOC, F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t\\r\u00a0]+", " "))).alias("lines"), F.element_at(F.split("text", "\n"), 1).alias("first"))
    own = own.withColumn("marks", F.array_compact(F.transform("lines", lambda x, no: F.when(x.rlike("(?i)^(?:item|part) "), mark(x, no)))))
    own = own.withColumn("heads", F.filter("marks", lambda m: m["item"].isNotNull())).withColumn("parts", F.when(F.upper("form").startswith("10-Q"), F.filter("marks", lambda m: m["part"].isNotNull())).otherwise(F.slice("marks", 1, 0)))
    tidy = lambda lines: F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), "^[ \n]+|[ \n]+$", "")

    def section(h, i):
        until = F.coalesce(F.try_element_at(F.col("heads"), i + 2)["no"], F.size("lines"))
        within = F.try_element_at(F.col("parts"), F.nullif(F.size(F.filter("parts", lambda p: p["no"] < h["no"])), F.lit(0)))["part"]
        number = F.array_position(F.array(*[F.lit(x) for x in ("I", "II", "III", "IV")]), within)
        key = F.coalesce(F.concat(F.lit("P"), number.cast("string"), F.lit("I"), h["item"]), h["item"])
        label = F.concat_ws(" \u2014 ", F.concat(F.lit("Item "), h["item"]), F.nullif(h["title"], F.lit("")))
        text = tidy(F.slice("lines", h["no"] + 2, until - h["no"] - 1))
        return F.struct(h["no"].alias("section"), key.alias("key"), label.alias("label"), F.substring(h["title"], 1, 200).alias("title"), text.alias("text"))

    own = own.withColumn("cut", F.transform("heads", section))
    if least:
        own = own.withColumn("cut", F.filter("cut", lambda x: F.length(x["text"]) > least))
    if keep != "every":
        size = (lambda x: F.length(x["text"])) if keep == "longest" else (lambda x: F.lit(0))
        turn = -1 if keep == "longest" else 1
        own = own.withColumn("cut", F.sort_array(F.transform("cut", lambda x: F.struct(x["key"].alias("key"), size(x).alias("size"), (turn * x["section"]).alias("turn"), x.alias("x"))), asc=False))
        # the best of a key comes first
        own = own.withColumn("cut", F.transform(F.filter("cut", lambda x, i: ~x["key"].eqNullSafe(F.try_element_at(F.col("cut"), F.nullif(i, F.lit(0)))["key"])), lambda x: x["x"]))
    whole = F.struct(F.lit(0).alias("section"), F.lit("0").alias("key"), F.lit("Full Document").alias("label"), F.substring("first", 1, 200).alias("title"), tidy(F.col("lines")).alias("text"))
    rows = own.select(*_DOC, F.inline(F.when(F.size("heads") > 0, F.col("cut")).otherwise(F.filter(F.array(whole), lambda x: x["text"] != ""))))
    return rows.select(*_DOC, "section", "key", "label", "title", F.substring("text", 1, clip).alias("text") if clip else F.col("text"))


def named_sections(filings: DataFrame, least: int = 100) -> DataFrame:
    """(doc, form, name, label, text) by the NAMED headings, anywhere in a line: from each to the next, if longer than
    ``least``; of equal names the last stays. A text without any is one section ``full``."""
    # each text is cut within its own row, as in item_sections; the patterns run on lines that name an item alone
    heads_of = lambda m: F.sort_array(F.filter(F.array(*[F.struct(m["no"].alias("no"), F.regexp_instr(m["line"], F.lit(p)).alias("at"), F.lit(n).alias("name")) for n, p in NAMED.items()]), lambda x: x["at"] > 0))
    own = filings.where("text is not null").select(*_DOC, "text", F.split("text", "\n").alias("lines"))
    marked = F.array_compact(F.transform("lines", lambda x, no: F.when(F.contains(F.lower(x), F.lit("item")), F.struct(no.alias("no"), F.lower(x).alias("line")))))
    own = own.withColumn("heads", F.flatten(F.transform(marked, heads_of)))
    none = F.array().cast("array<string>")

    def section(h, i):
        after = F.try_element_at(F.col("heads"), i + 2)
        until = F.coalesce(after["no"], F.size("lines"))
        line = F.element_at(F.col("lines"), h["no"] + 1)
        between = F.slice("lines", h["no"] + 2, F.greatest(until - h["no"] - 1, F.lit(0)))
        last = F.when(after.isNotNull(), F.array(F.substring(F.try_element_at(F.col("lines"), after["no"] + 1), F.lit(1), after["at"] - 1))).otherwise(none)
        text = F.when(after["no"] == h["no"], F.substring(line, h["at"], after["at"] - h["at"])).otherwise(F.array_join(F.concat(F.array(F.substring(line, h["at"], F.length(line))), between, last), "\n"))
        return F.struct(h["name"].alias("name"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))

    own = own.withColumn("cut", F.transform("heads", section)).withColumn("cut", F.filter("cut", lambda x: F.length(x["text"]) > least))
    own = own.withColumn("names", F.reverse(F.transform("cut", lambda x: x["name"])))
    own = own.withColumn("cut", F.filter("cut", lambda x, i: F.array_position(F.col("names"), x["name"]) == F.size("names") - i))
    whole = F.struct(F.lit("full").alias("name"), F.col("text"))
    label = F.when(F.col("name") == "full", "FULL FILING").otherwise(F.upper(F.replace("name", F.lit("_"), F.lit(" "))))
    return own.select(*_DOC, F.inline(F.when(F.size("cut") > 0, F.col("cut")).otherwise(F.array(whole)))).select(*_DOC, "name", label.alias("label"), "text")


def article_body(page: str | None, least_words: int = 100, least_chars: int = 10) -> str:
    """Paragraphs of an article element, or of the whole page if they are too few words."""
    page = re.sub(r"(?is)<(script|style|nav|header|footer|aside|form)\b.*?</\1\s*>|<!--.*?-->", " ", page or "")
    m = re.search(r"(?is)<article\b[^>]*>(.*?)(?:</article>|\Z)", page)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"(?i)</?(?:p|h[1-6]|li|blockquote|div)\b[^>]*>", m[1])] if m else []
    text = "\n".join(x for x in parts if len(x) > least_chars)
    return text if len(text.split()) >= least_words else " ".join(html.unescape(re.sub(r"<[^>]+>", " ", page)).split())


def page_texts(pages: DataFrame, key: str, function, lot: int = 100) -> DataFrame:
    """(key, text) of ``pages`` (key, html): a worker turns ``lot`` pages at a time into Python strings and gives their texts on at
    once, so that what it holds does not grow with the rows of a batch."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, lot):
                part = b.slice(at, lot)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([function(x) for x in part.column(1).to_pylist()], pa.string())], [key, "text"])

    return pages.select(key, "html").mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, text string")


def vectorised(function, kind: str):
    """A pandas UDF that applies a function of one or more strings to each row."""

    @F.pandas_udf(kind)
    def one(x: pd.Series) -> pd.Series:
        return x.map(function)

    @F.pandas_udf(kind)
    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([function(a, b) for a, b in zip(x, y)])

    return one if function.__code__.co_argcount == 1 or function.__defaults__ and function.__code__.co_argcount - len(function.__defaults__) == 1 else two
