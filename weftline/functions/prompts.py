"""Chat, instruction and few-shot texts built from columns. All wording is a parameter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import _col

SYSTEM_RULES = """Reply with one PySpark script for the report described by the user.
The script has to run as it stands on a cluster, over tables too large for one machine: express the report in joins,
aggregations and windows, keep rows on the executors, and finish with a DataFrame named `result`.
If the description leaves something open, choose the simplest reading and state it in the first line of the script."""


@dataclass(frozen=True)
class Wording:
    """The fixed text around descriptions and code in prompts."""

    system: str = SYSTEM_RULES
    few_shot_intro: str = "Here are requests with the code that answers them."
    few_shot_task: str = "Write the code for this request."
    request_label: str = "Request: "
    code_label: str = "Code:"
    divider: str = "---"
    instruction_intro: str = "The following is a task. Give the response that completes it."
    instruction_task: str = "Write Spark code for this request:"


DEFAULT_WORDING = Wording()


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(
    description: Column | str, code: Column | str | None = None, wording: Wording = DEFAULT_WORDING
) -> Column:
    """system, user and (when code is given) assistant message, as array<struct<role, content>>."""
    turns = [_message("system", F.lit(wording.system)), _message("user", _col(description))]
    if code is not None:
        turns.append(_message("assistant", _col(code)))
    return F.array(*turns)


def chatml_text(
    description: Column | str, code: Column | str | None = None, wording: Wording = DEFAULT_WORDING
) -> Column:
    """One block per role between the ChatML start and end markers."""
    code = F.lit("") if code is None else _col(code)
    blocks = [("system", F.lit(wording.system)), ("user", _col(description)), ("assistant", code)]
    return F.concat_ws(
        "\n", *[F.concat(F.lit(f"<|im_start|>{role}\n"), text, F.lit("<|im_end|>")) for role, text in blocks]
    )


def instruction_text(
    description: Column | str, code: Column | str | None = None, wording: Wording = DEFAULT_WORDING
) -> Column:
    """Instruction / response sections."""
    code = F.lit("") if code is None else _col(code)
    head = f"{wording.instruction_intro}\n\n### Instruction:\n{wording.instruction_task}\n"
    return F.concat(F.lit(head), _col(description), F.lit("\n\n### Response:\n"), code)


def few_shot_block(
    description: Column | str, code: Column | str, wording: Wording = DEFAULT_WORDING
) -> Column:
    return F.concat(
        F.lit(wording.request_label), _col(description), F.lit(f"\n{wording.code_label}\n"), _col(code),
        F.lit(f"\n{wording.divider}"),
    )


def few_shot_prompt(
    description: Column | str, hits: Column | str, wording: Wording = DEFAULT_WORDING
) -> Column:
    """Example blocks in the order of ``hits`` (array<struct<description, code, ...>>), then the request."""
    blocks = F.transform(_col(hits), lambda h: few_shot_block(h["description"], h["code"], wording))
    return F.concat(
        F.lit(f"{wording.few_shot_intro}\n\n"),
        F.coalesce(F.array_join(blocks, "\n"), F.lit("")),
        F.lit(f"\n\n{wording.few_shot_task}\n\n{wording.request_label}"),
        _col(description),
        F.lit(f"\n\n{wording.code_label}"),
    )
