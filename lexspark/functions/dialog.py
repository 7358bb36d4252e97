"""Prompts for models and what comes back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions.text import hidden_thoughts_removed


def chat_markup(role: Column, content: Column) -> Column:
    """One turn in ChatML."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), F.coalesce(content, F.lit("")), F.lit("<|im_end|>\n"))


def wrapped_prompt(model: Column, system: Column, user: Column) -> Column:
    """A prompt in the form of a model's family: ChatML for names with `qwen`, turn tags for `gemma`, else plain."""
    name = F.lower(F.coalesce(model, F.lit("")))
    tags = F.concat(F.lit("<start_of_turn>user\n"), system, F.lit("\n\n"), user, F.lit("<end_of_turn>\n<start_of_turn>model\n"))
    chat = F.concat(chat_markup(F.lit("system"), system), chat_markup(F.lit("user"), user), F.lit("<|im_start|>assistant\n"))
    return F.when(name.contains("qwen"), chat).when(name.contains("gemma"), tags).otherwise(F.concat(system, F.lit("\n\n"), user))


def without_prompt(output: Column, prompt: Column) -> Column:
    """What a model adds to its prompt."""
    return F.trim(F.when(F.startswith(output, prompt), F.substring(output, F.length(prompt) + 1, F.length(output))).otherwise(output))


def answer_json(raw: Column) -> Column:
    """The JSON object of an answer: bare, in a code fence, or inside prose, hidden thoughts aside; else null."""
    s = hidden_thoughts_removed(raw)
    fenced = F.trim(F.regexp_extract(s, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1))
    inside = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.when(F.get_json_object(c, "$").startswith("{"), c)
    return F.coalesce(ok(s), ok(F.when(fenced != "", fenced)), ok(F.when(inside != "", inside)))


def answer_field(raw: Column, field: str) -> Column:
    """A field of an answer's object, and the bare answer where there is none."""
    return F.coalesce(F.get_json_object(answer_json(raw), f"$.{field}"), hidden_thoughts_removed(raw))


def answer_paths(raw: Column) -> Column:
    """array<struct<number, title, summary, probability>>: the paths of an answer in order with defaults.

    Probabilities are kept within 0 and 1; one that is absent or no number is a half. Null where there are no paths.
    """
    schema = "struct<paths:array<struct<title:string,summary:string,success_probability:double>>>"
    paths = F.from_json(answer_json(raw), schema)["paths"]
    return F.transform(
        paths,
        lambda p, i: F.struct(
            (i + 1).alias("number"), F.coalesce(p["title"], F.lit("")).alias("title"), F.coalesce(p["summary"], F.lit("")).alias("summary"),
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(p["success_probability"], F.lit(0.5)), F.lit(0.5)))).alias("probability"),
        ),
    )
