"""Text functions as Column expressions.

White space is the Unicode set that web text uses, spelled out so that Spark and
any SQL engine agree; lengths that limits refer to are UTF-16 units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TEXT_LIMIT

SPACES = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE = f"[{SPACES}]"
BLANK = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"  # the same
LINK = r"\[([^\]]*)\]\(#(\d+)\)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, not wherever body names it: within
    lambdas nothing else shares an expression."""
    return F.get(F.transform(F.array(value), body), 0)


def trim(c) -> Column:
    return F.trim(col(c), F.lit(BLANK))  # from both ends; a pattern would try every place of the text


def squeeze(c) -> Column:
    return F.regexp_replace(trim(c), f"{SPACE}+", " ")


def utf16_length(c) -> Column:
    return F.octet_length(F.encode(col(c), "UTF-16BE")) / 2


def canonical(c) -> Column:
    """Lower case; letters, digits, white space and hyphens only; single spaces."""
    return squeeze(F.regexp_replace(F.lower(col(c)), rf"[^\p{{L}}\p{{N}}{SPACES}-]", ""))


def non_empty(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def split_commas(c) -> Column:
    """Canonical comma-separated parts; null gives none."""
    return F.coalesce(non_empty(F.transform(F.split(col(c), ","), canonical)), F.array().cast("array<string>"))


def split_words(c) -> Column:
    return F.coalesce(non_empty(F.split(canonical(c), " ")), F.array().cast("array<string>"))


def normalize_tag(c) -> Column:
    return F.regexp_replace(F.lower(trim(c)), f"{SPACE}+", "-")


def split_tags(c) -> Column:
    return F.coalesce(non_empty(F.transform(F.split(col(c), ","), trim)), F.array().cast("array<string>"))


def merge_tags(*lists) -> Column:
    """Ordered union of normalised tags, first occurrence kept."""
    none = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(col(x), none) for x in lists])
    return F.array_distinct(non_empty(F.transform(F.filter(every, lambda t: t.isNotNull()), normalize_tag)))


def strip_teaser(body, teaser) -> Column:
    body, teaser = col(body), col(teaser)
    return F.when(F.coalesce(teaser, F.lit("")) == "", body).otherwise(trim(F.replace(body, teaser, F.lit(""))))


def normalize_country(c) -> Column:
    return F.upper(trim(c))


def escape_html(c) -> Column:
    out = col(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def hashtag(c) -> Column:
    body = F.translate(col(c), BLANK + "-" + ".,@!'\"()", "_" * (len(BLANK) + 1))  # the characters after - go
    return F.concat(F.lit("#"), F.lower(body))


def title_words(c) -> Column:
    """Words of more than four units, before cleaning."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), f"{SPACE}+"), lambda w: utf16_length(w) > 4)


def hashtag_line(location, peoples, tags, title, date, ts) -> Column:
    none = F.array().cast("array<string>")
    every = F.concat(
        split_tags(location), split_tags(peoples), F.coalesce(col(tags), none), title_words(title),
        F.array(F.concat(F.lit("date_"), col(date)), F.concat(F.lit("ts_"), col(ts).cast("string"))),
    )
    named = F.filter(every, lambda t: ~F.lower(trim(t)).isin("", "none", "null"))
    return F.array_join(F.array_distinct(F.filter(F.transform(named, hashtag), lambda h: h != "#")), " ")


def header(date, country, location) -> Column:
    parts = F.array(F.upper(col(country)), col(location))
    parts = F.filter(parts, lambda p: p.isNotNull() & (trim(p) != ""))
    line = F.array_join(F.transform(parts, lambda p: escape_html(trim(p))), ", ")
    head = F.concat(F.lit("<b>⚡️</b> <i>"), col(date), F.lit("</i>"))
    return F.when(line == "", head).otherwise(F.concat(head, F.lit(" <b>"), line, F.lit("</b>")))


def _rejoin(text: Column, pattern: str, fill) -> Column:
    """Replaces each match in one pass: the text between matches, zipped with
    fill(first group, second group)."""

    def joined(text: Column) -> Column:
        groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2)]
        filled = F.zip_with(groups[0], groups[1], fill)
        return F.array_join(F.zip_with(F.split(text, pattern), filled, lambda b, f: F.concat(b, F.coalesce(f, F.lit("")))), "")

    return let(text, joined)


def substitute_links(text, links) -> Column:
    """[label](#N) becomes an anchor to link N, or its label where there is none."""
    links = col(links)

    def fill(label: Column, number: Column) -> Column:
        anchor = lambda href: F.when(F.size(href) > 0, F.concat(F.lit('<a href="'), escape_html(F.get(href, 0)["href"]), F.lit('">'), label, F.lit("</a>"))).otherwise(label)
        return let(number.cast("long"), lambda n: let(F.filter(links, lambda x: x["id"] == n), anchor))

    return _rejoin(col(text), LINK, fill)


def member_line(item_id, summary, links, channel) -> Column:
    anchor = F.concat(F.lit('<a href="https://t.me/'), escape_html(item_id), F.lit('">@'), escape_html(channel), F.lit("</a>"))
    return F.concat(F.lit("🔘 "), substitute_links(escape_html(summary), links), F.lit(" - "), anchor)


def render_template(template, values: dict[str, Column]) -> Column:
    """{name} placeholders in one pass, unknown ones empty; at most one blank line."""
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    pattern = r"\{([a-zA-Z]+)()\}"
    filled = let(table, lambda known: _rejoin(col(template), pattern, lambda name, _: F.coalesce(F.try_element_at(known, name), F.lit(""))))
    return trim(F.regexp_replace(filled, "\n{3,}", "\n\n"))


def first_fit(candidates: Column, limit: int = TEXT_LIMIT) -> Column:
    """The first candidate within the limit, else the last."""
    fits = F.filter(candidates, lambda t: utf16_length(t) <= limit)
    return F.coalesce(F.get(fits, 0), F.element_at(candidates, -1))


def chat_id(c) -> Column:
    return F.when(F.startswith(col(c), F.lit("@")), col(c)).otherwise(F.concat(F.lit("@"), col(c)))


def ref_of(raw) -> Column:
    """The payload's id, else its messageId, else empty."""
    pick = lambda p: F.nullif(F.get_json_object(col(raw), p), F.lit(""))
    return F.coalesce(pick("$.id"), pick("$.messageId"), F.lit(""))


def csv_cell(c) -> Column:
    text = col(c).cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.isNull(), "").when(text.rlike('[",\n\r]'), quoted).otherwise(text)


def fill(template, values: dict[str, Column]) -> Column:
    """{word} replaced; names without a value stay visible."""
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return let(table, lambda known: _rejoin(col(template), r"\{(\w+)()\}", lambda n, _: F.coalesce(F.try_element_at(known, n), F.concat(F.lit("{"), n, F.lit("}")))))


def redact(text, token) -> Column:
    return F.when(col(token) == "", col(text)).otherwise(F.replace(col(text), col(token), F.lit("[redacted]")))


def unavailable_reason(text) -> Column:
    """What follows ERROR: [tool] id: on a line, trimmed; null without one."""
    return F.nullif(trim(F.regexp_extract(col(text), r"ERROR:(?: \[[^\]]*\] [^:\s]+:)?([^\n]*)", 1)), F.lit(""))


def forward_origin(has_header, name, peer) -> Column:
    return F.when(~col(has_header), None).otherwise(F.coalesce(F.nullif(col(name), F.lit("")), col(peer).cast("string"), F.lit("unknown")))


def strip_at(c) -> Column:
    return F.regexp_replace(trim(c), "^@", "")


def target_ids(c) -> Column:
    """Distinct comma-separated ids without @, in first-seen order."""
    return F.array_distinct(non_empty(F.transform(split_tags(c), strip_at)))


def canonical_id(c) -> Column:
    ids = target_ids(c)
    return F.when(F.size(ids) == 1, F.get(ids, 0)).otherwise(F.raise_error(F.concat(F.lit("expected exactly one id: "), col(c))).cast("string"))


def watch_url(c) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), col(c))


def post_url(item_id) -> Column:
    return F.when(~F.startswith(col(item_id), F.lit("emulated/")), F.concat(F.lit("https://t.me/"), col(item_id)))


def share(fraction) -> Column:
    percent = F.floor(col(fraction) * 100 + 0.5).cast("long")
    return F.when(F.coalesce(col(fraction), F.lit(0.0)) <= 0, "0%").when(percent == 0, "<1%").otherwise(F.concat(percent.cast("string"), F.lit("%")))


def split_note(counts) -> Column:
    """reason n · reason n, of a map's counts above zero."""
    shown = F.filter(F.map_entries(col(counts)), lambda e: e["value"] > 0)
    return F.array_join(F.transform(shown, lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string"))), " · ")


def extract_text(blocks) -> Column:
    """Joined text blocks of a content array; an error when there are none."""
    said = F.filter(col(blocks), lambda b: (b["type"] == "text") & b["text"].isNotNull())
    joined = F.array_join(F.transform(said, lambda b: b["text"]), "")
    return F.when(F.size(said) > 0, joined).otherwise(F.raise_error(F.lit("no text block")).cast("string"))
