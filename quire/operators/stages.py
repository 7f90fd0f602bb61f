"""Stages that call a model: prompts from columns, answers through a model
interface on the executors, checked against the contract of a note."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import listing, state
from quire.session import cut

REQUIRED = ("In short", "Explanation")
_HEADING = re.compile(r"^## +(.*\S)\s*$")
_CODE = re.compile(r"^```[^\n]*\n(.*?)^```", re.M | re.S)


class NoteModel(Protocol):
    """One completion; an answer that is empty or cut off is an error."""

    def complete(self, prompt: str) -> str: ...


class ExtractiveModel:
    """A stand-in without a model: the first sentences and the listings."""

    def complete(self, prompt: str) -> str:
        source = prompt.partition("\n\n# Source\n\n")[2] or prompt
        prose = _CODE.sub("", source)
        sentences = re.split(r"(?<=[.!?])\s+", " ".join(prose.split()))
        code = "\n\n".join(f"```\n{block}```" for block in _CODE.findall(source))
        return f"## In short\n\n{sentences[0]}\n\n## Explanation\n\n{' '.join(sentences[:8])}" + (f"\n\n## Code\n\n{code}" if code else "")


def render(template: str, **fields: Column) -> Column:
    """A template with {{name}} filled from columns; an unknown name is an
    error at once."""
    out: list[Column] = []
    for k, part in enumerate(re.split(r"\{\{(\w+)\}\}", template)):
        if k % 2 and part not in fields:
            raise KeyError(f"the template asks for {part!r}")
        out.append(F.coalesce(fields[part].cast("string"), F.lit("")) if k % 2 else F.lit(part))
    return F.concat(*out)


def split_answer(answer: str) -> dict[str, str]:
    """Sections of an answer by heading, outside listings; the outer fence of a
    wrapped answer is dropped."""
    lines = answer.strip().split("\n")
    if len(lines) > 2 and lines[0].startswith("```") and lines[-1].strip() == "```" and any(x.startswith("## ") for x in lines):
        lines = lines[1:-1]
    found: dict[str, list[str]] = {}
    name, fenced = None, False
    for line in lines:
        if line.lstrip().startswith("```"):
            fenced = not fenced
        if not fenced and (m := _HEADING.match(line)):
            name = m[1]
            found[name] = []
        elif name is not None:
            found[name].append(line)
    return {k: "\n".join(v).strip() for k, v in found.items()}


def lost(answer: str, source: str) -> list[str]:
    have = {" ".join(x.split()) for block in _CODE.findall(answer) for x in block.split("\n")}
    wanted = [" ".join(x.split()) for block in _CODE.findall(source) for x in block.split("\n") if x.strip()]
    return [x for x in wanted if x not in have]


def best_answer(model: NoteModel, prompt: str, source: str, retries: int = 1, reminder: int = 60) -> dict[str, str]:
    """Of up to retries + 1 answers the first that loses least; a retry is
    reminded of what was lost."""
    best, least, asked = None, None, prompt
    for _ in range(retries + 1):
        answer = model.complete(asked)
        parts = split_answer(answer)
        if missing := [n for n in REQUIRED if not parts.get(n)]:
            raise ValueError("the answer has no section " + ", ".join(missing))
        gone = lost(answer, source)
        if least is None or len(gone) < least:
            best, least = parts, len(gone)
        if not gone:
            break
        asked = prompt + "\n\nKeep these lines:\n" + "\n".join(gone[:reminder])
    return best


def generate(work: DataFrame, make_model: Callable[[], NoteModel], max_tokens: int = 6000) -> DataFrame:
    """(id, status, error, sections) for work (id, prompt, source).  A failure
    is a row, not the end of the job; a source above the limit is refused.  The
    model is made once per task."""
    kind = work.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for batch in batches:
            status, error, sections = [], [], []
            for prompt, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    if len(source or "") // 4 > max_tokens:
                        raise ValueError("the source is too long")
                    made = best_answer(model, prompt or "", source or "")
                    status.append("done")
                    error.append(None)
                    sections.append(list(made.items()))
                except Exception as e:  # noqa: BLE001
                    status.append("failed")
                    error.append(str(e)[:400])
                    sections.append(None)
            kinds = pa.map_(pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(status), pa.array(error, pa.string()), pa.array(sections, kinds)], names=["id", "status", "error", "sections"])

    return work.select("id", "prompt", "source").mapInArrow(run, f"id {kind}, status string, error string, sections map<string,string>")


def advance(work: DataFrame, events: DataFrame, make_model: Callable[[], NoteModel], at: Column, stopped: DataFrame | None = None, max_tokens: int = 6000) -> tuple[DataFrame, DataFrame]:
    """One pass of a stage: what isn't done yet (id, prompt, source), and whose
    job (``stopped``: (id)) nobody asked to stop, goes to the model.  Returns
    the answers and the events (id, event, status, ts, error) to append, a
    start and an end for each; a failure ends only its own row.  Answers are
    written once, so that both are of one call."""
    order = F.struct("ts", "event")
    last = events.groupBy("id").agg(F.max_by("status", order).alias("status"))
    left = work.join(last.where(F.col("status") == state.DONE), "id", "left_anti")
    if stopped is not None:
        left = left.join(stopped.select("id"), "id", "left_anti")
    made = cut(generate(left, make_model, max_tokens))
    begun = made.select("id", F.lit(0).alias("event"), F.lit(state.RUNNING).alias("status"), at.alias("ts"), F.lit(None).cast("string").alias("error"))
    return made, begun.unionByName(made.select("id", F.lit(1).alias("event"), "status", at.alias("ts"), "error"))


#: What a note is asked for; listings, formulas and sections are added as a book has them.
NOTE = """Write a note in {{language}} on {{section}} {{title}}, pages {{pages}} of {{source}} ({{material}}).
Use the sections {{names}}.{{technical}}{{slides}}{{parts}}

# Source

{{text}}"""
FIGURE = "Describe in {{language}} the figure under {{heading}}, captioned {{caption}}.\n\n# Source\n\n{{context}}"


def note_prompt(chunks: DataFrame) -> DataFrame:
    """(id, prompt, source) of chunks (id, section, title, page_start,
    page_end, text, parts, book_title, domain, language, slides): a book with
    listings is asked to keep them, one with formulas for these, slides to be
    explained, and a note of several sections to cover each."""
    c = F.col
    domain = F.coalesce(c("domain"), F.lit("general"))
    material = F.when(c("slides"), F.concat(domain, F.lit(" training slides"))).otherwise(F.concat(domain, F.lit(" textbook")))
    code = F.when(listing.wanted(c("domain")), F.lit(" Copy every listing into a section Code, line by line."))
    formulas = F.when(listing.formulas_wanted(c("domain")), F.lit(" Put formulas as LaTeX into a section Formulas."))
    slides = F.when(c("slides"), F.lit(" Explain what the slides only name."))
    parts = F.when(F.size("parts") > 0, F.concat(F.lit("\nCover each of these sections:\n"), F.array_join(F.transform("parts", lambda p: F.concat(F.lit("- "), p)), "\n")))
    prompt = render(
        NOTE, language=F.when(c("language") == "pl", "Polish").otherwise("English"), section=c("section"), title=c("title"), pages=F.concat_ws("-", "page_start", "page_end"),
        source=c("book_title"), material=material, names=F.lit(", ".join(REQUIRED)), technical=F.concat_ws("", code, formulas), slides=slides, parts=parts, text=c("text"),
    )
    return chunks.select("id", prompt.alias("prompt"), c("text").alias("source"))


def describe(work: DataFrame, make_model: Callable[[], NoteModel]) -> DataFrame:
    """(id, status, error, description) for figures (id, heading, caption,
    context, language).  A failure is a row; the model is made once per task."""
    kind = work.schema["id"].dataType.simpleString()
    c = F.col
    named = lambda x, none: F.coalesce(F.nullif(c(x), F.lit("")), F.lit(none))
    prompt = render(FIGURE, language=F.when(c("language") == "pl", "Polish").otherwise("English"), heading=named("heading", "no heading"), caption=named("caption", "nothing"), context=c("context"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for batch in batches:
            rows: list[tuple] = []
            for asked in batch.column(1).to_pylist():
                try:
                    rows.append(("done", None, " ".join(model.complete(asked).split())))
                except Exception as e:  # noqa: BLE001
                    rows.append(("failed", str(e)[:400], None))
            columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "status", "error", "description"])

    return work.select("id", prompt.alias("prompt")).mapInArrow(run, f"id {kind}, status string, error string, description string")


def insert_description(note: Column, file: Column, description: Column) -> Column:
    """Put a description under the embed of one figure, in place of the line
    that is there; doing it again replaces it."""
    quoted = F.concat(F.lit(r"(?m)^(!\[\[[^\]\n]*\Q"), file, F.lit(r"\E\]\]\n)\*[^\n]*\*$"))
    text = F.regexp_replace(F.regexp_replace(T.squeeze(description), r"\\", r"\\\\"), r"\$", r"\\\$")
    return F.regexp_replace(note, quoted, F.concat(F.lit("$1*"), text, F.lit("*")))


def context_for(chunk: Column, caption: Column, width: int = 1200) -> Column:
    """``width`` characters round the caption, else the start of the chunk."""
    at = F.when(F.length(caption) > 0, F.instr(chunk, F.substring(caption, 1, 40))).otherwise(0)
    start = F.when(at > 0, F.greatest(at - width // 2, F.lit(1))).otherwise(1)
    return F.substring(chunk, start, F.lit(width))
