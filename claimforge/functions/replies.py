"""Tolerant reading of external replies: fenced or embedded JSON, aliases and fallbacks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .keywords import numbering_removed
from .text import WS, distinct_by, let, no_ws, split_clean, strip

LISTS = ("products", "data", "results", "items", "output", "result")
PRODUCT = {
    "product_id": ("product_id", "id"),
    "product_name": ("product_name", "title", "name"),
    "product_url": ("product_url", "url", "link"),
    "product_source": ("product_source", "source", "platform"),
    "price": ("price",),
    "brand": ("brand",),
    "manufacturer": ("manufacturer", "Manufacturer"),
    "matched_keywords": ("matched_keywords",),
    "description": ("description", "summary", "product_raw_text"),
}
#: A reply with one of these is a single product.
SINGLE = ("title", "product_name", "url")
TERM_TEXT = ("text", "term", "keyword_text", "keyword")
TERM_LISTS = ("filtered_core_terms", "filtered_terms", "core_terms", "terms", "keywords")
FILTER_NOTICE = "筛选结果为空，已回退为直接使用原始核心术语"
REFINE_NOTICE = "精炼结果为空，保留原始术语"
VARIANTS = "array<variant>"


def unfenced(reply: Column) -> Column:
    """A reply without a code fence."""
    return strip(F.coalesce(F.nullif(F.regexp_extract(reply, r"(?s)```(?:json|JSON)?(?U:\s*)(.*?)```", 1), F.lit("")), reply))


def tolerant_json(reply: Column, first: str = "object") -> Column:
    """The reply as a variant: the outermost {...}, then [...] (or the other way round), then all
    of it, each as it is and without trailing commas; null if nothing parses."""
    text = unfenced(reply)
    shapes = [r"(?s)(\{.*\})", r"(?s)(\[.*\])"][:: 1 if first == "object" else -1]
    tries = [F.nullif(F.regexp_extract(text, s, 1), F.lit("")) for s in shapes] + [text]
    mended = lambda c: F.regexp_replace(c, r",(?U:\s)*([}\]])", "$1")
    return F.coalesce(*(F.try_parse_json(f(t)) for t in tries for f in (lambda c: c, mended)))


@F.pandas_udf(StringType())
def python_literal_json(replies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Replies written as Python literals, as JSON; null if they aren't. For leftovers only. A tuple, which objects in a
    row are, is no list: it comes out as a text."""
    import ast
    import json

    def one(text: str | None) -> str | None:
        try:
            value = ast.literal_eval(text)
            return json.dumps(str(value) if isinstance(value, tuple) else value, ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    for part in replies:
        yield part.map(one)


def at(v: Column, *names: str, kind: str = "string") -> Column:
    """First field that is there and truthy: empty strings, empty arrays and zeros fall through."""
    tries = [F.try_variant_get(v, f"$.{n}", kind) for n in names]
    if kind == "string":
        tries = [F.when(~strip(t).isin("", "0", "[]", "{}", "false", "0.0"), t) for t in tries]
    return F.coalesce(*tries)


def field(v: Column, name: str) -> Column:
    """A field as a variant; SQL null if it isn't there (a JSON null is there)."""
    return F.try_variant_get(v, f"$['{name}']", "variant")


def is_text(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))


def is_object(x: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.lit(False))


def said(x: Column) -> Column:
    """A value as text, null if it is missing, null, false, zero or empty; a text "0" or of blanks counts."""
    kind, text = F.schema_of_variant(x), F.try_variant_get(x, "$", "string")
    no = F.when(kind == "STRING", text == "").when(kind == "BOOLEAN", text == "false").when(F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")), text.isin("[]", "{}")).otherwise(F.try_variant_get(x, "$", "double") == 0)
    return F.when(~F.coalesce(no, F.lit(True)), text)


def first_said(v: Column, *names: str) -> Column:
    return F.coalesce(*(said(field(v, n)) for n in names))


def texts(list_: Column) -> Column:
    """The stripped, non-blank texts of a list; other items are left out. Null if there is no list."""
    items = F.try_variant_get(list_, "$", VARIANTS)
    return F.filter(F.transform(F.filter(items, is_text), lambda x: strip(F.try_variant_get(x, "$", "string"))), lambda x: x != "")


def braced(reply: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))


def bracketed(reply: Column) -> Column:
    """From the first [ to the last ]; null if there is none."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), F.lit(""))


def jsonish(reply: Column) -> Column:
    """The reply without fence marks as a variant: the outermost {..}, then [..], then all of it, each as JSON, as a Python
    literal, and as JSON without trailing commas; null if nothing parses."""
    text = F.regexp_replace(reply, r"(?i)```(?:json)?", "")
    tries = []
    for c in (braced(text), bracketed(text), strip(text)):
        plain = F.try_parse_json(c)
        # The UDF gets a null wherever JSON has said it already.
        tries += [plain, F.try_parse_json(python_literal_json(F.when(plain.isNull(), c))), F.try_parse_json(F.regexp_replace(c, rf",{WS}*([}}\]])", "$1"))]
    return F.coalesce(*tries)


def product_items(reply: Column) -> Column:
    """Array of variants: a list, the first list under a known key, or a single product; of a text that isn't JSON its [..]."""

    def items(v: Column) -> Column:
        listed = F.coalesce(F.try_variant_get(v, "$", VARIANTS), *(F.try_variant_get(v, f"$.{n}", VARIANTS) for n in LISTS), F.array().cast(VARIANTS))
        single = F.coalesce(*(field(v, n) for n in SINGLE)).isNotNull()
        return F.when((F.size(listed) == 0) & single, F.array(v)).otherwise(listed)

    return let(F.coalesce(F.try_parse_json(reply), F.try_parse_json(bracketed(reply))), items)


def product(v: Column, keyword: Column | None = None) -> Column:
    """Struct of a product from its aliases, each the first that isn't empty; without matched keywords the keyword searched for.
    The raw payload is kept as JSON."""
    pictures = F.coalesce(*(F.when(F.size(p) > 0, p) for p in (F.try_variant_get(v, f"$.{n}", "array<string>") for n in ("picture", "images", "image_urls"))), F.array().cast("array<string>"))
    fields = {k: first_said(v, *names) for k, names in PRODUCT.items()}
    if keyword is not None:
        fields["matched_keywords"] = F.coalesce(fields["matched_keywords"], keyword)
    return F.struct(*(F.coalesce(c, F.lit("")).alias(k) for k, c in fields.items()), pictures.alias("picture"), F.to_json(v).alias("raw_payload"))


def distinct_objects(objects: Column, primary: Column) -> Column:
    """Distinct texts, white space aside, in order, without the primary one."""
    return distinct_by(F.filter(objects, lambda x: (no_ws(x) != "") & ((no_ws(primary) == "") | (no_ws(x) != no_ws(primary)))), no_ws)


def product_objects(reply: Column, variant: Column | None = None) -> Column:
    """Struct of primary and search objects. General: a JSON object, else a JSON array (head and tail), else the parts of the text behind
    its label, unquoted. The other variants have lists only: the shortest [..], else the parts; all but the first are search objects."""
    none = F.array().cast("array<string>")
    made = lambda primary, search: F.struct(primary.alias("primary"), search.alias("search"))
    headed = lambda listed: let(listed, lambda x: let(F.coalesce(F.get(x, F.lit(0)), F.lit("")), lambda head: made(head, distinct_objects(F.when(F.size(x) > 1, F.slice(x, 2, 1 << 30)).otherwise(none), head))))
    parts = F.transform(split_clean(strip(F.regexp_replace(strip(reply), r"^[^：]*[：:]", "")), r"[,，、\n]"), lambda x: F.regexp_replace(x, "^[\"']+|[\"']+$", ""))
    v = F.try_parse_json(braced(reply))
    primary = F.coalesce(strip(F.try_variant_get(v, "$.primary_product_object", "string")), F.lit(""))
    general = F.when(is_object(v), made(primary, distinct_objects(F.coalesce(texts(field(v, "search_product_objects")), none), primary))).otherwise(headed(F.coalesce(texts(F.try_parse_json(bracketed(reply))), parts)))
    if variant is None:
        return general
    shortest = F.nullif(F.regexp_extract(reply, r"(?s)(\[.*?\])", 1), F.lit(""))
    return F.when(variant == "general", general).otherwise(headed(F.coalesce(texts(F.try_parse_json(shortest)), parts)))


def grounded(objects: Column, primary: Column, context: Column) -> Column:
    """The objects that occur in the context (white space aside) and aren't the primary one."""
    ctx = no_ws(context)
    return F.filter(objects, lambda x: (no_ws(x) != "") & F.contains(ctx, no_ws(x)) & (no_ws(x) != no_ws(primary)))


def invention_point(reply: Column, variant: Column) -> Column:
    """Struct of point, source, direction; parts are split from the left, for home_appliances from the right."""
    left = F.split(reply, r"\|")
    three = r"(?s)^(.*)\|([^|]*)\|([^|]*)$"
    right = F.when(reply.rlike(three), F.array(*(F.regexp_extract(reply, three, i) for i in (1, 2, 3)))).otherwise(left)
    parts = F.when(variant == "home_appliances", right).otherwise(F.slice(left, 1, 2))
    part = lambda i: strip(F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
    return F.struct(part(0).alias("point"), F.coalesce(F.nullif(part(1), F.lit("")), F.lit("说明书内容")).alias("source"), part(2).alias("direction"))


def _term(text: Column, source: Column, kind: Column) -> Column:
    return F.struct(text.alias("text"), source.alias("source"), kind.alias("type"))


def listed_terms(reply: Column) -> Column:
    """Array of (text, source, type): the items of a JSON array, texts or objects; without one, or if it doesn't parse, the
    lines without their numbers."""
    items = F.try_variant_get(F.try_parse_json(bracketed(reply)), "$", VARIANTS)
    own = F.transform(F.filter(items, lambda x: is_text(x) | is_object(x)), lambda x: F.when(is_text(x), _term(F.try_variant_get(x, "$", "string"), F.lit(""), F.lit(""))).otherwise(_term(*(F.coalesce(F.try_variant_get(x, f"$.{n}", "string"), F.lit("")) for n in ("text", "source", "type")))))
    lines = F.filter(F.transform(split_clean(reply, "\n"), numbering_removed), lambda x: x != "")
    return F.coalesce(own, F.transform(lines, lambda x: _term(x, F.lit("权利要求原文"), F.lit("CORE_TERM"))))


def filtered_terms(reply: Column, originals: Column) -> Column:
    """Struct of terms (text, category, source_location, confidence) and log. A list, or the first known container of an object;
    keys are compared in lower case with runs of blanks and dashes as one underscore. Texts have 0.7, objects the first usable
    confidence, else 0.8. Without any term the first 12 originals at 0.6."""

    def entries(v: Column) -> Column:
        return F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(F.regexp_replace(F.lower(strip(e["key"])), r"(?U:[\s-])+", "_").alias("key"), e["value"].alias("value")))

    def named(e: Column, name: str) -> Column:
        hits = F.filter(e, lambda x: x["key"] == name)
        return F.get(hits, F.size(hits) - 1)["value"]

    made = lambda text, category, source, sure: F.struct(text.alias("text"), category.alias("category"), source.alias("source_location"), sure.alias("confidence"))

    def term(x: Column) -> Column:
        def of(e: Column) -> Column:
            first = lambda *names: F.coalesce(*(said(named(e, n)) for n in names))
            sure = F.try_variant_get(F.coalesce(*(F.when(said(named(e, n)).isNotNull(), named(e, n)) for n in ("confidence", "confidence_score", "score"))), "$", "double")
            return made(strip(F.coalesce(first(*TERM_TEXT), F.lit(""))), F.coalesce(first("category"), F.lit("unknown")), F.coalesce(first("source_location", "source", "reason"), F.lit("")), F.coalesce(sure, F.lit(0.8)))

        plain = made(strip(F.try_variant_get(x, "$", "string")), F.lit("unknown"), F.lit("coerced"), F.lit(0.7))
        return F.when(is_text(x), plain).when(is_object(x), let(entries(x), of))

    def read(v: Column) -> Column:
        def of(e: Column) -> Column:
            # The first container that is there decides, whatever it holds.
            held = F.coalesce(*(named(e, n) for n in TERM_LISTS))
            items = F.try_variant_get(F.when(is_object(v), held).otherwise(v), "$", VARIANTS)
            parsed = F.filter(F.transform(F.coalesce(items, F.array().cast(VARIANTS)), term), lambda t: t["text"] != "")
            log = F.coalesce(*(said(named(e, n)) for n in ("filter_log", "log", "message")), F.lit(""))
            back = F.transform(F.filter(F.slice(originals, 1, 12), lambda x: x != ""), lambda x: made(x, F.lit("unknown"), F.lit("fallback"), F.lit(0.6)))
            none = (F.size(parsed) == 0) & (F.coalesce(F.size(originals), F.lit(0)) > 0)
            return F.struct(F.when(none, back).otherwise(parsed).alias("terms"), F.when(none & (log == ""), FILTER_NOTICE).otherwise(log).alias("log"))

        return let(F.coalesce(entries(v), F.array().cast("array<struct<key:string,value:variant>>")), of)

    return let(jsonish(reply), read)


def strict_terms(reply: Column) -> Column:
    """X28, other variants: array of (text, category, source_location, confidence) of the list filtered_core_terms of the outermost {..}; nothing
    else is read, and there is no fallback."""
    v = F.try_parse_json(braced(reply))
    items = F.filter(F.try_variant_get(v, "$.filtered_core_terms", VARIANTS), lambda x: is_object(x) & said(field(x, "text")).isNotNull())
    plain = lambda x, name, default: F.coalesce(F.try_variant_get(x, f"$.{name}", "string"), F.lit(default))
    made = F.transform(items, lambda x: F.struct(said(field(x, "text")).alias("text"), plain(x, "category", "unknown").alias("category"), plain(x, "source_location", "").alias("source_location"), F.coalesce(F.try_variant_get(x, "$.confidence", "double"), F.lit(0.8)).alias("confidence")))
    return F.coalesce(made, F.array().cast("array<struct<text:string,category:string,source_location:string,confidence:double>>"))


def combined_keywords(reply: Column, variant: Column | None = None) -> Column:
    """Array of (keyword_text, keyword_type, combination_pattern, confidence): the objects of the reply's [..] that have a text, even if
    none has. General: without a [..] that parses, every line at 0.6. The other variants: lines of more than three
    characters, and only of a [..] that doesn't parse."""
    made = lambda text, kind, pattern, sure: F.struct(text.alias("keyword_text"), kind.alias("keyword_type"), pattern.alias("combination_pattern"), sure.alias("confidence"))
    array = bracketed(reply)
    items = F.try_variant_get(F.try_parse_json(array), "$", VARIANTS)
    plain = lambda x, name, default: F.coalesce(F.try_variant_get(x, f"$.{name}", "string"), F.lit(default))
    parsed = F.transform(F.filter(items, lambda x: is_object(x) & said(field(x, "keyword_text")).isNotNull()), lambda x: made(said(field(x, "keyword_text")), plain(x, "keyword_type", "unknown"), plain(x, "combination_pattern", ""), F.coalesce(F.try_variant_get(x, "$.confidence", "double"), F.lit(0.8))))
    lines = split_clean(reply, "\n")
    if variant is not None:
        lines = F.when(variant == "general", lines).when(array.isNotNull(), F.filter(lines, lambda x: F.length(x) > 3)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(parsed, F.transform(lines, lambda x: made(x, F.lit("unknown"), F.lit("text_extraction"), F.lit(0.6))))


def flat_content(content: Column, glue: str = "") -> Column:
    """A string, or the text parts of a list of parts, joined."""
    parts = F.try_variant_get(F.try_parse_json(content), "$", "array<variant>")
    texts = F.filter(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")))), lambda x: x.isNotNull())
    return F.coalesce(F.array_join(texts, glue), content)


def reply_features(reply: Column, claim_id: Column) -> Column:
    """Array of (feature_id, feature_text, claim_id) with both id and text."""
    v = tolerant_json(reply)
    items = F.coalesce(*(F.try_variant_get(v, f"$.{n}", "array<variant>") for n in ("features", "data", "result", "items")), F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    made = F.transform(items, lambda x: F.struct(strip(F.coalesce(at(x, "feature_id"), F.lit(""))).alias("feature_id"), strip(F.coalesce(at(x, "feature_text"), F.lit(""))).alias("feature_text"), F.coalesce(at(x, "claim_id"), claim_id).alias("claim_id")))
    return F.filter(made, lambda f: (f["feature_id"] != "") & (f["feature_text"] != ""))


def tagged_lists(reply: Column, first: str = "场景", second: str = "人群") -> Column:
    """Struct of scenario_words and audience_words. A {..} that parses gives its lists; one that doesn't, the lines after each
    tagged header, without bullets and numbers; a reply without {..} gives nothing."""
    body = braced(reply)
    v = F.try_parse_json(body)
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("at"), none.alias("a"), none.alias("b"))

    def step(s: Column, line: Column) -> Column:
        head = F.when(F.contains(line, F.lit(first)), "a").when(F.contains(line, F.lit(second)), "b")
        item = strip(F.regexp_replace(line, r"^[-•·0-9.、 ]+", ""))
        put = lambda k: F.when(head.isNull() & (s["at"] == k) & (F.length(line) > 1) & (item != ""), F.array_append(s[k], item)).otherwise(s[k]).alias(k)
        return F.struct(F.coalesce(head, s["at"]).alias("at"), put("a"), put("b"))

    lines = F.aggregate(F.when(body.isNotNull() & v.isNull(), split_clean(reply, "\n")).otherwise(none), start, step)
    words = lambda name: F.filter(F.transform(F.try_variant_get(v, f"$.{name}", VARIANTS), lambda x: strip(F.try_variant_get(x, "$", "string"))), lambda x: x.isNotNull() & (x != ""))
    listed = lambda name, k: F.when(v.isNotNull(), F.coalesce(words(name), none)).otherwise(lines[k]).alias(name)
    return F.struct(listed("scenario_words", "a"), listed("audience_words", "b"))


def scene_words(reply: Column) -> Column:
    """Array of (text, category, inference_reason); lines have no category."""
    items = F.try_variant_get(tolerant_json(reply, "array"), "$", "array<variant>")
    made = lambda t, c, r: F.struct(t.alias("text"), c.alias("category"), r.alias("inference_reason"))
    parsed = F.transform(items, lambda x: made(strip(F.coalesce(at(x, "text"), F.try_variant_get(x, "$", "string"), F.lit(""))), F.coalesce(at(x, "category"), F.lit("")), F.coalesce(at(x, "inference_reason"), F.lit(""))))
    lines = F.transform(split_clean(reply, "\n"), lambda x: made(numbering_removed(x), F.lit(""), F.lit("")))
    return F.filter(F.coalesce(parsed, lines), lambda s: s["text"] != "")


def refined_terms(reply: Column, originals: Column) -> Column:
    """Struct of terms (text, source, type) and log. The objects of the reply's [..], the log being what follows its first ];
    of a [..] that doesn't parse the lines, but those that begin with 精炼 or 说明; if that leaves none, the originals (of the same
    fields) with a notice."""
    array = bracketed(reply)
    v = F.try_parse_json(array)
    items = F.filter(F.try_variant_get(v, "$", VARIANTS), is_object)
    of = lambda x, name, default: F.coalesce(F.try_variant_get(x, f"$.{name}", "string"), F.lit(default))
    parsed = F.transform(items, lambda x: _term(of(x, "text", ""), of(x, "source", "精炼生成"), of(x, "type", "REFINED_FEATURE")))
    lines = F.filter(F.transform(F.when(array.isNotNull() & v.isNull(), split_clean(reply, "\n")), numbering_removed), lambda x: (x != "") & ~F.startswith(x, F.lit("精炼")) & ~F.startswith(x, F.lit("说明")))
    found = F.coalesce(parsed, F.transform(lines, lambda x: _term(x, F.lit("精炼生成"), F.lit("REFINED_FEATURE"))), F.slice(originals, 1, 0))
    log = F.when(v.isNotNull() | array.isNull(), strip(F.regexp_replace(F.regexp_extract(reply, r"(?s)\](.*)", 1), r"^(?U:[\s*-])+", ""))).otherwise("")

    def made(found: Column) -> Column:
        none = (F.size(found) == 0) & (F.coalesce(F.size(originals), F.lit(0)) > 0)
        return F.struct(F.when(none, originals).otherwise(found).alias("terms"), F.when(none, REFINE_NOTICE).otherwise(log).alias("log"))

    return let(found, made)
