"""Chat prompts and training text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The instruction and the system message of the translation task.
INSTRUCTION = (
    "Please translate the following Chinese text into English and provide only the "
    "translated content, nothing else."
)
SYSTEM_MESSAGE = "You are an expert in translating Chinese to English."


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around a turn by role; ``None`` is every other role."""

    bos: str
    opening: dict[str | None, str]
    closing: dict[str | None, str]
    generation: str
    eos: str
    has_system: bool = True


# Chat mark-up by template family.
TEMPLATES = {
    "chatml": ChatTemplate(
        bos="",
        opening={
            "system": "<|im_start|>system\n",
            "user": "<|im_start|>user\n",
            None: "<|im_start|>assistant\n",
        },
        closing={None: "<|im_end|>\n"},
        generation="<|im_start|>assistant\n",
        eos="<|im_end|>",
    ),
    "llama3": ChatTemplate(
        bos="<|begin_of_text|>",
        opening={
            "system": "<|start_header_id|>system<|end_header_id|>\n\n",
            "user": "<|start_header_id|>user<|end_header_id|>\n\n",
            None: "<|start_header_id|>assistant<|end_header_id|>\n\n",
        },
        closing={None: "<|eot_id|>"},
        generation="<|start_header_id|>assistant<|end_header_id|>\n\n",
        eos="<|eot_id|>",
    ),
    "inst": ChatTemplate(
        bos="<s>",
        opening={"user": "[INST] ", None: " "},
        closing={"user": " [/INST]", None: "</s>"},
        generation="",
        eos="</s>",
        has_system=False,
    ),
}


def _by_role(marks: dict[str | None, str], role: Column) -> Column:
    named = [(r, m) for r, m in marks.items() if r is not None]
    if not named:
        return F.lit(marks[None])
    choice = F.when(role == named[0][0], named[0][1])
    for r, m in named[1:]:
        choice = choice.when(role == r, m)
    return choice.otherwise(marks[None])


def _turn(template: ChatTemplate, role: Column, content: Column) -> Column:
    return F.concat(_by_role(template.opening, role), content, _by_role(template.closing, role))


def instruction(source: Column) -> Column:
    return F.concat(F.lit(INSTRUCTION + "\n"), source)


def messages(source: Column, model: Column) -> Column:
    """System and user message; models named like ``mistral`` take no system message."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    user = message("user", instruction(source))
    return F.when(
        F.contains(F.lower(model), F.lit("mistral")), F.array(user)
    ).otherwise(F.array(message("system", F.lit(SYSTEM_MESSAGE)), user))


def render(template: ChatTemplate, turns: Column) -> Column:
    """Chat text of a message array, ending where the model starts to answer."""
    if not template.has_system:
        turns = F.filter(turns, lambda m: m.role != "system")
    body = F.array_join(F.transform(turns, lambda m: _turn(template, m.role, m.content)), "")
    return F.concat(F.lit(template.bos), body, F.lit(template.generation))


def with_prompts(pairs: DataFrame, template: ChatTemplate, model: str) -> DataFrame:
    """Add ``prompt``, and ``text`` = prompt, target and end mark for training."""
    prompt = render(template, messages(F.col("source"), F.lit(model)))
    return pairs.withColumn("prompt", prompt).withColumn(
        "text", F.concat("prompt", "target", F.lit(template.eos))
    )


def render_conversations(turns: DataFrame, template: ChatTemplate) -> DataFrame:
    """Conversations ``(conv_id, turn, role, text)`` as ``(conv_id, turn, text)``: one rendered row
    per turn, the start mark on the first turn and the generation mark on the last.

    Joined in the order of the turns, the rows of a conversation are its whole text; however long
    it is, it never gathers in one task.
    """
    if not template.has_system:
        turns = turns.where("role <> 'system'")
    ends = turns.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    return turns.join(ends, "conv_id").select(
        "conv_id",
        "turn",
        F.concat(
            F.when(F.col("turn") == F.col("first"), template.bos).otherwise(""),
            _turn(template, F.col("role"), F.col("text")),
            F.when(F.col("turn") == F.col("last"), template.generation).otherwise(""),
        ).alias("text"),
    )
