"""Tags, best-effort JSON, descriptions and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def given(c: Column) -> Column:
    """Null where the value counts as missing: an empty string."""
    return F.when(c != "", c)


def normalize_tags(tags: Column, most: int | None = 80) -> Column:
    """Trimmed, lower-case, without blanks, each once in first-seen order, at most so many."""
    out = F.array_distinct(F.filter(F.transform(tags, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))
    return F.slice(out, 1, most) if most is not None else out


def tags_from_response(raw: Column, key_hint: str = "tags", most: int | None = 80) -> Column:
    """Tags of a JSON list, of the first list under the hint, tags, objects or functional_tags, or of comma-separated text."""
    body = unfenced(raw)
    listed = [F.from_json(body, "array<string>"), *(F.from_json(F.get_json_object(body, f"$.{k}"), "array<string>") for k in dict.fromkeys([key_hint, "tags", "objects", "functional_tags"]))]
    looks_json = F.trim(body).rlike(r"^[\[{]")
    return normalize_tags(F.coalesce(*(F.when(F.size(x) > 0, x) for x in listed), F.when(~looks_json, F.split(body, ","))), most)


def unfenced(raw: Column) -> Column:
    """Without a code fence around."""
    return F.trim(F.regexp_replace(F.trim(raw), r"^```(?:json|JSON)?\s*|\s*```$", ""))


def _valid(s: Column) -> Column:
    """s if it is an object or array and nothing else."""
    return F.when(s.rlike(r"(?s)^\s*(?:\{.*\}|\[.*\])\s*$") & F.try_parse_json(s).isNotNull(), s)


def json_between(raw: Column) -> Column:
    """The valid JSON in a reply, as text: the whole, or from the first brace to the last, or bracket; else null."""
    s = unfenced(raw)
    return F.coalesce(*map(_valid, (s, F.regexp_extract(s, r"(?s)(\{.*\})", 1), F.regexp_extract(s, r"(?s)(\[.*\])", 1))))


def json_from(raw: Column) -> Column:
    """The valid JSON in a description, as text: the whole, or from the first brace, or bracket, to the end; else null."""
    s = F.trim(raw)
    return F.coalesce(*map(_valid, (s, F.regexp_extract(s, r"(?s)(\{.*)$", 1), F.regexp_extract(s, r"(?s)(\[.*)$", 1))))


def frame_description(raw: Column) -> Column:
    """caption, room_type_guess, description, scene_layout and objects, with defaults; text that is no JSON becomes the description."""
    body = json_from(raw)
    take = lambda k: F.coalesce(F.get_json_object(body, f"$.{k}"), F.lit(""))
    objects = F.get_json_object(body, "$.objects")
    return F.struct(
        take("caption").alias("caption"),
        take("room_type_guess").alias("room_type_guess"),
        F.when(body.isNull(), F.coalesce(raw, F.lit(""))).otherwise(take("description")).alias("description"),
        take("scene_layout").alias("scene_layout"),
        F.when(objects.startswith("["), objects).otherwise("[]").alias("objects"),
    )


def ensure_text(*parts: Column) -> Column:
    """Parts that are there, on lines of their own; give lists through joined()."""
    return F.concat_ws("\n", *(given(p) for p in parts))


def joined(values: Column) -> Column:
    """A list's values that are there, with '; ' between."""
    return given(F.array_join(F.filter(values, lambda x: x.isNotNull() & (x != "")), "; "))


def object_text(name: Column, object_id: Column, attributes: Column, description: Column, affordances: Column, state: Column, location: Column, relations: Column) -> Column:
    """One sentence of each thing known about an object, with stated defaults."""
    # fixed values: the labels and fall-back phrases of this text are part of the data format
    title = F.coalesce(given(name), given(object_id), F.lit("object"))
    return F.concat_ws(
        " ",
        F.concat(F.lit("Object: "), title, F.lit(".")),
        F.concat(F.lit("Attributes: "), joined(attributes), F.lit(".")),
        given(description),
        F.concat(F.lit("Affordances: "), F.coalesce(joined(affordances), F.lit("(no affordances listed)")), F.lit(".")),
        F.concat(F.lit("State: "), F.coalesce(given(state), F.lit("unknown state")), F.lit(".")),
        F.concat(F.lit("Located at "), F.coalesce(given(location), F.lit("an unspecified location")), F.lit(".")),
        F.concat(F.lit("Relations: "), joined(relations), F.lit(".")),
    )


def safe_id(raw: Column, most: int = 80, head: int = 70) -> Column:
    """Runs of characters other than letters, digits, dot, underscore and hyphen become one underscore; long ids end in a digest."""
    clean = F.regexp_replace(raw, r"[^A-Za-z0-9._-]+", "_")
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, head), F.lit("_"), F.substring(F.md5(clean), 1, 8))).otherwise(clean)


def functional_tags(tags: Column, object_tags: Column) -> Column:
    """Words of a comma- or dot-separated list that no object tag is, hyphens between kept words kept, empties dropped."""
    words = F.transform(F.split(F.regexp_replace(tags, r"\.", ","), ","), lambda x: F.trim(x))
    kept = F.transform(words, lambda w: F.array_join(F.filter(F.split(w, " "), lambda x: ~F.array_contains(object_tags, x) & (x != "")), " "))
    return F.filter(kept, lambda x: ~x.isin("", "-"))


def tag_prompt(tags: Column) -> Column:
    return F.array_join(tags, ". ")


def tags_of_prompt(prompt: Column) -> Column:
    return F.filter(F.transform(F.split(prompt, r"\.|\|"), lambda x: F.trim(x)), lambda x: x != "")


def embedding_input(text: Column, most: int = 30000) -> Column:
    """What is embedded: at most so many characters, on one line."""
    return F.regexp_replace(F.substring(text, 1, most), r"\n", " ")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def packed_sentences(text: Column, budget: int) -> Column:
    """Sentences packed greedily in parts of at most `budget` estimated tokens, in order; longer sentences are cut."""
    sentences = F.filter(F.split(text, r"(?<=[.?!])\s+"), lambda x: x != "")
    step = 4 * budget
    pieces = F.flatten(F.transform(sentences, lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(s) - 1) / step), F.lit(0)).cast("int")), lambda k: F.substr(s, k * step + 1, F.lit(step)))))
    return F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.floor((F.length(F.element_at(out, -1)) + 1 + F.length(s)) / 4) <= budget),
            F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.concat(F.element_at(out, -1), F.lit(" "), s))),
        ).otherwise(F.concat(out, F.array(s))),
    )


def overlap(query: Column, text: Column) -> Column:
    """How many words of the query the text contains."""
    words = F.filter(F.split(F.lower(query), r"\W+"), lambda x: x != "")
    low = F.lower(text)
    return F.size(F.filter(words, lambda w: F.contains(low, w)))


def location_query(query: Column) -> Column:
    """object, room and floor of 'the X in Y in floor N'; a text of another form is split at ' in '."""
    pattern = r"(?i)^\s*(?:the\s+)?(.+?)\s+in\s+(?:the\s+)?(.+?)\s+(?:in|on)\s+floor\s+(\S+)\s*$"
    parts = F.split(query, r"(?i)\s+in\s+")
    part = lambda k, n: F.coalesce(given(F.regexp_extract(query, pattern, k)), F.trim(F.get(parts, F.lit(n))) if n < 2 else F.lit(None).cast("string"))
    return F.struct(part(1, 0).alias("object"), part(2, 1).alias("room"), part(3, 2).alias("floor"))


def content_hash(*fields: Column) -> Column:
    """sha256 of the fields as JSON; nulls keep their place."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def scene_base(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/?$", 1)


def first_number(text: Column) -> Column:
    return given(F.regexp_extract(text, r"(\d+)", 1)).cast("long")


def data_url(image: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(image))
