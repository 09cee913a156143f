"""Prompts and chat texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

#: The marks of a rendered chat.
CHAT_START, CHAT_REPLY = "[gMASK]<sop>", "<|assistant|>"
#: Instructions of our own within an inference prompt, for callers that read none from a file; the slot stays as it is.
INNER_PROMPT = """
Say the sentence plainly, without figures of speech; then give the words of what you said, parted by blanks.
Answer in two lines, "1. 改写：" and the plain sentence, "2. 分词：" and its words.
Sentence: {sentence}
"""


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), text(content).alias("content"))


def chat(system: Column, user: Column) -> Column:
    """The two messages of a request."""
    return F.array(message("system", system), message("user", user))


def rendered_message(role: Column, content: Column, metadata: Column | None = None) -> Column:
    """A message in a rendered chat; nothing if its content is empty."""
    head = F.concat(F.lit("<|"), role, F.lit("|>"), text(metadata) if metadata is not None else F.lit(""), F.lit("\n"))
    return F.when(text(content) == "", F.lit("")).otherwise(F.concat(head, text(content)))


def rendered_chat(messages: Column, reply: bool = True, tools: Column | None = None) -> Column:
    """An array of (role, content) messages as one text. tools: a text for the tools, set before the messages."""
    body = F.array_join(F.transform(messages, lambda m: rendered_message(m["role"], m["content"])), "")
    head = [F.lit(CHAT_START)] + ([F.when(text(tools) == "", F.lit("")).otherwise(F.concat(F.lit("<|system|>\n"), text(tools)))] if tools is not None else [])
    return F.concat(*head, body, F.lit(CHAT_REPLY if reply else ""))


def judge_prompt(instructions: str | Column, *parts: Column) -> Column:
    """The texts to be judged, one after another, and then the instructions."""
    return F.concat(*(text(p) for p in parts), F.lit(instructions) if isinstance(instructions, str) else instructions)


def inference_prompt(sentence: Column, inner: str = INNER_PROMPT) -> Column:
    return F.concat(F.lit(f"\n<|system|>\n{inner}\n<|user|>\n用户输入："), text(sentence), F.lit("\n<|assistant|>\n输出：\n"))
