"""Row construction: persona and example rendering, chat messages, preference rows, ids, templates, renamed metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordinals

MESSAGE = "struct<role:string,content:string>"
#: The sections of a persona, in their order; each is a list of texts. The last is optional.
SECTIONS = ("identity", "personality", "speech_style", "relationships", "facts", "boundaries", "notes")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def bullet_section(title: str, items: Column, none: str = "(none)") -> Column:
    """A titled list of bullets; a notice where it is empty; null where it is absent."""
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(items.isNotNull(), F.concat(F.lit(f"{title}:\n"), F.when(F.size(items) == 0, F.lit(f"- {none}")).otherwise(lines)))


def render_persona(name: Column, sections: Mapping[str, Column], opening: str, closing: Sequence[str] = (), titles: Mapping[str, str] | None = None) -> Column:
    """A system prompt: the opening with the name, the sections in fixed order without the absent ones, then the closing paragraphs."""
    parts = [bullet_section((titles or {}).get(s, s), sections[s]) for s in SECTIONS if s in sections]
    return F.concat_ws("\n\n", F.format_string(opening, name), *parts, *map(F.lit, closing))


def render_examples(examples: DataFrame, order: str, user: str = "user", assistant: str = "assistant", none: str = "(no examples)") -> DataFrame:
    """One row: two lines for each example, in order."""
    line = F.concat(F.lit("user: "), F.col(user), F.lit("\nassistant: "), F.col(assistant))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return examples.agg(F.when(F.count(F.lit(1)) == 0, F.lit(none)).otherwise(F.array_join(F.transform(listed, lambda x: x["l"]), "\n")).alias("examples"))


def few_shot(system: Column | None, examples: Column | None, user: Column) -> Column:
    """Messages of a request: the system prompt and (user, assistant) examples if there are any, then the user."""
    parts = [F.array(message("system", system))] if system is not None else []
    if examples is not None:
        parts.append(F.flatten(F.transform(examples, lambda e: F.array(message("user", e["user"]), message("assistant", e["assistant"])))))
    return F.concat(*parts, F.array(message("user", user)))


def preference_row(system: Column, user: Column, chosen: Column, rejected: Column) -> tuple[Column, Column]:
    """messages and rejected_response of a preference row."""
    return F.array(message("system", system), message("user", user), message("assistant", chosen)).alias("messages"), rejected.alias("rejected_response")


def preference_row_issue(messages: Column, rejected: Column) -> Column:
    """Why a preference row breaks its contract, or null: role order, contents, and an answer that differs from the rejected one."""
    roles = F.transform(messages, lambda m: m["role"])
    blank = F.exists(messages, lambda m: m["content"].isNull() | (F.trim(m["content"]) == ""))
    chosen = F.element_at(messages, -1)["content"]
    return (
        F.when(~F.coalesce(roles == F.array(*map(F.lit, ("system", "user", "assistant"))), F.lit(False)), "role_order").when(blank, "blank_message")
        .when(rejected.isNull() | (F.trim(rejected) == ""), "blank_rejected").when(rejected == chosen, "same_answers")
    )


def with_constants(rows: DataFrame, key: str, table: Mapping[object, Mapping[str, object]]) -> DataFrame:
    """``rows`` with the constants of their category; a category that isn't known gets nulls."""
    names = list(next(iter(table.values())))
    flat = [(k, *(v[n] for n in names)) for k, v in table.items()]
    dim = rows.sparkSession.createDataFrame(flat, [key, *names]).withColumn(key, F.col(key).cast(rows.schema[key].dataType))
    return rows.join(F.broadcast(dim), key, "left")  # as many rows as the caller wrote down


def review_ids(rows: DataFrame, prefix: str, accepted: Column, order: str, group: str) -> DataFrame:
    """``rows`` with review_id: the position among the accepted rows of a run, null for the others."""
    own = rows.withColumn("_ok", F.coalesce(accepted, F.lit(False)))
    taken = ordinals.ranked(own.where("_ok"), [F.col(order)], "_place", [group]).withColumn("review_id", F.format_string(prefix + "%02d", "_place"))
    return taken.drop("_ok", "_place").unionByName(own.where("not _ok").withColumn("review_id", F.lit(None).cast("string")).drop("_ok"))


def renamed_metrics(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Columns of one prefix under another."""
    return rows.withColumnsRenamed({c: new + c[len(old) :] for c in rows.columns if c.startswith(old)})


def result_template(ids: Column, labels: Sequence[str], dimensions: Sequence[str]) -> Column:
    """A blank result to be filled in: null scores of every label and dimension."""
    blank = F.create_map(*(x for d in dimensions for x in (F.lit(d), F.lit(None).cast("int"))))
    return F.struct(ids.alias("review_id"), F.lit(None).cast("string").alias("winner"), F.lit(None).cast("string").alias("clearly_worse"), F.create_map(*(x for v in labels for x in (F.lit(v), blank))).alias("scores"))


def review_page(title: Column, fields: Sequence[tuple[str, Column]]) -> Column:
    """A section of a review document."""
    return F.concat_ws("\n\n", F.concat(F.lit("## "), title), *(F.concat(F.lit(f"**{n}**: "), F.coalesce(c.cast("string"), F.lit(""))) for n, c in fields))


def judge_request(user: Column, candidate: Column) -> Column:
    """Untrusted texts as JSON, so that nothing in them reads as an instruction."""
    return F.to_json(F.struct(user.alias("user"), candidate.alias("candidate")))


def contiguous_issues(rows: DataFrame, ident: str, prefix: str, order: str, group: str) -> DataFrame:
    """Rows whose id isn't the prefix and their 1-based, four-digit position within the group."""
    placed = ordinals.ranked(rows, [F.col(order)], "_place", [group])
    return placed.withColumn("expected_id", F.format_string(prefix + "%04d", "_place")).drop("_place").where(~F.col(ident).eqNullSafe(F.col("expected_id")))
