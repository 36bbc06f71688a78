"""Column builders for texts and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"^\s+|\s+$"


def stripped(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col, WHITE, "")


def first_filled(*cols: Column) -> Column:
    """The first value that is not blank, as it stands; null if there is none."""
    return F.coalesce(*[F.when(stripped(c) != "", c) for c in cols])


def row_text(*cols: Column, most: int = 2000) -> Column:
    """The first filled value, stripped and cut; the empty text if there is none."""
    return F.coalesce(F.substring(stripped(first_filled(*cols)), 1, most), F.lit(""))


def rendered(messages: Column) -> Column:
    """``role: content`` of the messages with content, joined by blank lines; null if none is left.

    ``messages`` is an array of structs with ``role`` and ``content``.
    """
    kept = F.filter(messages, lambda m: F.coalesce(m["content"], F.lit("")) != "")
    lines = F.transform(kept, lambda m: F.concat(F.coalesce(F.when(m["role"] != "", m["role"]), F.lit("user")), F.lit(": "), m["content"]))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n\n"))


def question_answer(q: Column, a: Column) -> Column:
    """Null without a question; the question alone without an answer; both with a blank line between."""
    return F.when(first_filled(q).isNotNull(), F.concat_ws("\n\n", q, first_filled(a)))


def messages_from_json(col: Column) -> Column:
    """A JSON list of messages in either convention (role/content, from/value); null if it is none."""
    parsed = F.from_json(col, "array<struct<role:string,content:string,`from`:string,value:string>>", {"mode": "PERMISSIVE"})
    return F.transform(parsed, lambda m: F.struct(F.coalesce(m["role"], m["from"]).alias("role"), F.coalesce(m["content"], m["value"]).alias("content")))


def caption(values: Column, most: int = 2000) -> Column:
    """Values joined by a space, video marks replaced by a space, stripped and cut."""
    return F.substring(stripped(F.replace(F.array_join(values, " "), F.lit("<video>"), F.lit(" "))), 1, most)


def scene_key(key: Column) -> Column:
    """The folder part of a frame's key without leading dots and slashes."""
    return F.regexp_replace(F.regexp_extract(key, "^(.*)/[^/]*$", 1), r"^[./]+", "")


def any_messages(*lists: Column) -> Column:
    """The first of several message lists that renders to a text."""
    return F.coalesce(*map(rendered, lists))


def or_prompt(col: Column, prompt: str) -> Column:
    """A default prompt where the text is null or empty."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(prompt))


def spliced(ids: Column, mark: Column, media: Column) -> Column:
    """``ids`` with the i-th entry of ``media`` in place of the i-th mark; raises at run time if their numbers differ."""
    def run(holes: Column) -> Column:
        filled = F.transform(ids, lambda x, i: F.when(x == mark, F.get(media, (F.array_position(holes, i) - 1).cast("int"))).otherwise(x))
        return F.when(F.assert_true(F.size(holes) == F.size(media), F.lit("placeholders and media differ in number")).isNull(), filled)

    places = F.filter(F.transform(ids, lambda x, i: F.when(x == mark, i)), F.isnotnull)
    return F.get(F.transform(F.array(places), run), F.lit(0))
