"""Chat formatting with typed content parts.

A conversation is a set of rows ``(conv_id, turn, role, parts)``; a part is a
struct of kind ``text``, ``image``, ``audio`` or ``document``.  A visitor
walks the parts in order: text is escaped, any other kind becomes a
placeholder with a running number, its reference is recorded as an attachment
together with the number of tokens that the placeholder stands for.

The template marks each turn as ``[TURN:role]text[/TURN]`` and a placeholder
as ``[PART:kind:number]``.  Control strings inside texts and roles, also those
of other well-known templates, get a backslash after their first character
(one more, where backslashes stand there already); reading back takes one
away.  So no text can forge a mark, and every text comes back unchanged.

The loss mask is a list of code point spans over the formatted string: the
content of each assistant turn.

Order is by turn, then role, then the parts; a null turn comes first, a null
role or text is empty, a null part is left out; a turn without parts is an
empty one; repeated rows are repeated turns.  A conversation is one output
value, so its rows meet in one task; conversations never do.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = ("struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>")
PATCH, FRAMES, PAGE_TOKENS = 14, 25, 256   # pixels a token's side; tokens a second; tokens a page

#: What may not stand in a text as it is: these marks, after "[" or "<".
CONTROL = r"/?TURN[:\]]|PART:|/?INST\]|<SYS>>|</SYS>>|/?s>|\|"
ESCAPE = re.compile(rf"([\[<])(?=\\*(?:{CONTROL}))")
UNESCAPE = re.compile(rf"([\[<])\\(?=\\*(?:{CONTROL}))")
TURN = re.compile(r"\[TURN:(.*?)\](.*?)\[/TURN\]", re.S)
MARK = re.compile(r"\[PART:(text|image|audio|document):(\d+)\]")


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def _role_out(role: str) -> str:
    """A role stands before a closing bracket: brackets are coded."""
    return role.replace("%", "%25").replace("]", "%5D").replace("[", "%5B").replace("<", "%3C")


def _role_in(role: str) -> str:
    return role.replace("%3C", "<").replace("%5B", "[").replace("%5D", "]").replace("%25", "%")


class Visitor:
    """Flattens typed parts into text; collects attachments.  Neighbouring
    texts are escaped together, so no mark can be pieced together of them."""

    def __init__(self):
        self.attachments: list[dict] = []
        self.out: list[str] = []
        self.plain: list[str] = []

    def turn(self, parts) -> str:
        """The formatted content of one turn."""
        self.out = []
        for part in parts or []:
            if part is not None:
                getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_text)(part)
        self._flush()
        return "".join(self.out)

    def visit_text(self, part) -> None:
        self.plain.append(part.get("text") or "")

    def visit_image(self, part) -> None:
        self._attach("image", part, math.ceil((part.get("width") or 0) / PATCH)
                     * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * FRAMES))

    def visit_document(self, part) -> None:
        self._attach("document", part, (part.get("pages") or 0) * PAGE_TOKENS)

    def _flush(self) -> None:
        self.out.append(escape("".join(self.plain)))
        self.plain = []

    def _attach(self, kind, part, tokens) -> None:
        self._flush()
        number = len(self.attachments)
        self.attachments.append({"number": number, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self.out.append(f"[PART:{kind}:{number}]")


def format_turns(turns: list[tuple[str, list]]):
    """``(role, parts)`` in order -> formatted string, loss spans, attachments."""
    visitor, out, spans, at = Visitor(), [], [], 0
    for role, parts in turns:
        head = f"[TURN:{_role_out(role or '')}]"
        body = visitor.turn(parts)
        if role == "assistant":
            spans.append([at + len(head), at + len(head) + len(body)])
        out += [head, body, "[/TURN]"]
        at += len(head) + len(body) + len("[/TURN]")
    return "".join(out), spans, visitor.attachments


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` in order, unescaped; placeholders stay as they are."""
    return [(_role_in(r), unescape(t)) for r, t in TURN.findall(formatted)]


def format_conversations(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(conv_id, formatted, loss_spans, attachments, expanded_tokens)``."""
    grouped = (rows.select(key, "turn", "role", "parts").groupBy(key)
               .agg(F.sort_array(F.collect_list(F.struct(
                   F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"),
                   F.coalesce("role", F.lit("")).alias("role"), "parts"))).alias("turns")))

    def run(batches):
        for b in batches:
            got = [format_turns([(t["role"], t["parts"]) for t in turns]) for turns in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([g[0] for g in got], pa.string()),
                pa.array([g[1] for g in got], pa.list_(pa.list_(pa.int64()))),
                pa.array([g[2] for g in got], pa.list_(pa.struct([
                    ("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
                pa.array([sum(a["tokens"] for a in g[2]) for g in got], pa.int64())],
                names=[key, "formatted", "loss_spans", "attachments", "expanded_tokens"])

    kind = rows.schema[key].dataType.simpleString()
    return grouped.mapInArrow(run, f"{key} {kind}, formatted string, loss_spans array<array<bigint>>, "
                              "attachments array<struct<number:int,kind:string,ref:string,tokens:bigint>>, "
                              "expanded_tokens bigint")


def text_parts(rows: DataFrame, text: str = "text") -> DataFrame:
    """Plain rows ``(…, text)`` as rows with one text part (null: empty)."""
    part = F.expr(f"from_json('{{}}', '{PART}')")
    return rows.withColumn("parts", F.array(part.withField("kind", F.lit("text"))
                                            .withField("text", F.coalesce(F.col(text), F.lit("")))))


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the formatted strings hold, read from them and their loss spans."""
    def run(batches):
        for b in batches:
            n, turns_sha, loss_n, loss_sha, size = [], [], [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = read_turns(text)
                loss = "".join(unescape(text[a:z]) for a, z in spans)
                n.append(len(turns))
                turns_sha.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                loss_n.append(len(loss))
                loss_sha.append(hashlib.sha256(loss.encode()).hexdigest())
                size.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(turns_sha, pa.string()), pa.array(loss_n, pa.int64()),
                 pa.array(loss_sha, pa.string()), pa.array(size, pa.int64())],
                names=[key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema[key].dataType.simpleString()
    return formatted.select(key, "formatted", "loss_spans").mapInArrow(
        run, f"{key} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
