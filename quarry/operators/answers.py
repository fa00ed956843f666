"""Contexts, deterministic answers and the parsing of judges' replies, as column expressions. Models are plug-ins: any function
from a prompt column to a text column may stand in for ``extract_answer``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of replies.
NO_DOCUMENTS = "I don't have enough context to answer this question."
NOT_FOUND = "I could not find the answer in the provided documents."


def context(docs: Column, versioned: bool = False) -> Column:
    """``- Document [i]: text`` lines from an array of structs (rank, text, version), in the order of ranks."""
    line = lambda d: F.concat(F.lit("- Document ["), d["rank"].cast("string"), F.lit("]"), *([F.lit(" (Version "), d["version"], F.lit(")")] if versioned else []), F.lit(": "), d["text"], F.lit("\n"))
    return F.array_join(F.transform(F.array_sort(docs), line), "")


def gather(results: DataFrame, *more: str) -> DataFrame:
    """(query_id, docs): a query's documents as one array, bounded by the k of the retrieval."""
    return results.groupBy("query_id").agg(F.collect_list(F.struct("rank", "text", *more)).alias("docs"))


def extract_answer(question: Column, text: Column) -> Column:
    """The longest context line with a question word longer than three letters (the first of equally long ones), else the first
    line that is not blank; with the templates for directors and casts."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: strip(F.regexp_replace(strip(x), "^[- ]+", ""))), lambda x: x != "")
    words = F.filter(F.split(F.lower(F.replace(F.coalesce(question, F.lit("")), F.lit("?"), F.lit(""))), r"\s+"), lambda w: F.length(w) > 3)
    longest = F.aggregate(F.filter(lines, lambda x: F.exists(words, lambda w: F.contains(F.lower(x), w))), F.lit(""), lambda s, x: F.when(F.length(x) > F.length(s), x).otherwise(s))
    best = F.when(longest != "", longest).otherwise(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))
    asked, parts = F.lower(F.coalesce(question, F.lit(""))), F.split(best, r"\.")
    director = F.get(F.filter(parts, lambda p: F.lower(p).rlike("directors|directed")), F.lit(0))
    cast = F.get(F.filter(parts, lambda p: F.contains(F.lower(p), F.lit("cast"))), F.lit(0))
    plain = F.concat(F.lit("Synthesized answer: "), best)
    about_cast = F.contains(asked, F.lit("featuring")) | F.contains(asked, F.lit("cast"))
    return (
        F.when(best == "", NOT_FOUND)
        .when(F.contains(asked, F.lit("directed by")), F.coalesce(F.concat(F.lit("Based on the context, "), strip(director), F.lit(".")), plain))
        .when(about_cast, F.coalesce(F.concat(F.lit("The movie features cast members: "), strip(F.replace(cast, F.lit("Cast:"), F.lit(""))), F.lit(".")), plain))
        .otherwise(plain)
    )


def answer(question: Column, docs: Column) -> Column:
    return F.when(F.size(docs) == 0, NO_DOCUMENTS).otherwise(extract_answer(question, context(docs)))


#: What a prompt asks for, and the note on a version.
TASK = "Answer the question from the documents below and from nothing else. Say so if they do not hold the answer. Be brief and exact."
NOTE = "[Version: the question is about release {version}. Prefer what its documents say.]"
#: What each judge is asked. Braces name the prompt's parts.
JUDGES = {
    "faithfulness": "Is the answer faithful to the context, all of it?\n\nContext:\n{context}\n\nAnswer:\n{answer}",
    "answer_relevancy": "How relevant is the answer to the question?\n\nQuestion:\n{question}\n\nAnswer:\n{answer}",
    "context_recall": "How much of the ground truth does the context hold?\n\nGround truth:\n{truth}\n\nContext:\n{context}",
    "noise_sensitivity": "How far did documents without relevance mislead the answer?\n\nQuestion:\n{question}\n\nAnswer:\n{answer}\n\nContext:\n{context}",
}
_REPLY = '\n\nReply with one JSON object: {"reasoning": "...", "score": a number from 0 to 1}'
#: The scores of the canned judge (fixed values).
CANNED = {"faithfulness": 0.95, "answer_relevancy": 0.90, "context_recall": 0.92, "noise_sensitivity": 0.05}


def prompt(question: Column, docs: Column, version: Column | None = None) -> Column:
    """The prompt of an answer from an array of structs (rank, text, version): the task, a note where a version is asked for, the documents
    with their versions, the question."""
    note = F.lit("") if version is None else F.coalesce(F.concat(F.replace(F.lit(NOTE), F.lit("{version}"), version), F.lit("\n\n")), F.lit(""))
    return F.concat(F.lit(TASK + "\n\n"), note, F.lit("Context:\n"), context(docs, versioned=version is not None), F.lit("\nQuestion: "), question, F.lit("\nAnswer:"))


def judge_prompt(kind: str, **parts: Column) -> Column:
    """The prompt of one of JUDGES. Parts that are null count as empty."""
    pieces = re.split(r"\{(\w+)\}", JUDGES[kind])
    return F.concat(*(F.coalesce(parts[x], F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(pieces) if x), F.lit(_REPLY))


def canned_reply(prompt: Column) -> Column:
    """The deterministic judge: a fixed score for each kind of prompt, told by its first line; no reply to others."""
    out = F.lit(None).cast("string")
    for kind, text in JUDGES.items():
        out = F.when(prompt.startswith(text.partition("\n")[0]), F.lit('{"reasoning": "canned", "score": %.2f}' % CANNED[kind])).otherwise(out)
    return out


def parse_score(reply: Column, default: float = 0.5) -> Column:
    """``score`` of the first JSON object, else the first of 0.x, 1.0, 0 and 1, else the default."""
    block = F.regexp_extract(reply, r"(?s)(\{.*?\})", 1)
    said = F.get_json_object(block, "$.score").try_cast("double")
    number = F.regexp_extract(reply, r"(\b0\.\d+|\b1\.0|\b0\b|\b1\b)", 1).try_cast("double")
    return F.coalesce(said, number, F.lit(default))


def parse_flags(reply: Column, n: int) -> Column:
    """``relevance`` of the first JSON object, else a flag for each line that says yes/true or no/false; cut or filled with false to n."""
    block = F.regexp_extract(reply, r"(?s)(\{.*?\})", 1)
    listed = F.from_json(block, "relevance array<boolean>")["relevance"]
    lines = F.transform(F.split(F.lower(reply), "\n"), lambda x: F.when(x.rlike("yes|true"), True).when(x.rlike("no|false"), False))
    flags = F.coalesce(listed, F.filter(lines, lambda x: x.isNotNull()))
    return F.slice(F.concat(flags, F.array_repeat(F.lit(False), n)), 1, n)
