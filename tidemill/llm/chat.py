"""Chat formatting over typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them in order: text is escaped
and kept, every other part becomes a numbered placeholder and an attachment record with the tokens it will expand
to. Turns are marked, control strings inside texts and roles are escaped reversibly, and the loss mask lists the
spans of assistant text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import small_batches, table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
#: Strings that chat models read as control; none is left whole inside an escaped text.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_BEFORE = re.compile("(?=(?:" + "|".join(map(re.escape, CONTROL)) + "))(.)", re.S)
_AFTER = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(END), re.S)
_PLACE = re.compile(r"<\|(?:image|audio|document|unknown):(\d+)\|>")

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    """Backslashes are doubled, then one is put after the first character of every control string."""
    return _BEFORE.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _AFTER.sub(r"\1", text)


class Flatten:
    """Visits the parts of one conversation. Attachments are numbered from 0 in order of appearance."""

    def __init__(self, count: Callable[[str], int], tile: int = 512, tile_tokens: int = 170, base_tokens: int = 85, audio_rate: float = 25.0, page_tokens: int = 600):
        self.count, self.attachments, self.tokens, self.errors = count, [], 0, []
        self.tile, self.tile_tokens, self.base_tokens, self.audio_rate, self.page_tokens = tile, tile_tokens, base_tokens, audio_rate, page_tokens

    def visit(self, part: dict) -> str:
        found = getattr(self, f"visit_{part.get('type') or 'text'}", None)
        return found(part) if found else self.visit_unknown(part)

    def visit_text(self, part: dict) -> str:
        text = part.get("text") or ""
        self.tokens += self.count(text)
        return escape(text)

    def visit_unknown(self, part: dict) -> str:
        self.errors.append(f"no such part: {part['type']}")
        return self._attach("unknown", part, 0)

    def visit_image(self, part: dict) -> str:
        tiles = math.ceil((part.get("width") or self.tile) / self.tile) * math.ceil((part.get("height") or self.tile) / self.tile)
        return self._attach("image", part, self.base_tokens + self.tile_tokens * tiles)

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, (part.get("pages") or 1) * self.page_tokens)

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        n = len(self.attachments)
        self.attachments.append({"position": n, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.tokens += tokens
        return f"<|{kind}:{n}|>"


def render(turns: list[tuple[str, list[dict]]], count: Callable[[str], int] = lambda text: len(text.split())) -> dict:
    """Turns (role, parts) in order -> formatted, loss spans [start, end) in code points, attachments, expanded tokens, errors.

    Neighbouring text parts are one text: they are joined before they are escaped, so that no control string can be put
    together from pieces, and counted as one.
    """
    visitor, out, at, spans = Flatten(count), [], 0, []
    for role, parts in turns:
        head = TURN + escape(role) + SAYS
        start = where = at + len(head)
        out.append(head)
        for is_text, some in groupby(parts, key=lambda p: (p.get("type") or "text") == "text"):
            for part in [{"text": "".join(p.get("text") or "" for p in some)}] if is_text else some:
                piece = visitor.visit(part)
                if is_text and role == "assistant":
                    spans.append((where, where + len(piece)))
                out.append(piece)
                where += len(piece)
        out.append(END)
        at = where + len(END)
    return {"formatted": "".join(out), "loss": spans, "attachments": visitor.attachments, "expanded_tokens": visitor.tokens, "errors": visitor.errors}


def parse_parts(formatted: str) -> list[tuple[str, list[str | int]]]:
    """Roles and contents of a formatted conversation: texts, and the numbers of attachments between them."""
    out = []
    for role, body in _TURN.findall(formatted):
        pieces = _PLACE.split(body)
        out.append((unescape(role), [unescape(x) if k % 2 == 0 else int(x) for k, x in enumerate(pieces) if k % 2 or x]))
    return out


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; placeholders of attachments are taken out of the texts."""
    return [(role, "".join(x for x in parts if isinstance(x, str))) for role, parts in parse_parts(formatted)]


def token_counter(path: str | None) -> Callable[[str], int]:
    """Counts tokens with a tokenizer file, or words where there is none."""
    if path is None:
        return lambda text: len(text.split())
    from tidemill.llm.tokens import encoder

    return encoder(path).count


FORMATTED = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("attachments", pa.list_(pa.struct([("position", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64()), ("errors", pa.list_(pa.string())),
])
_DDL = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<position:int,type:string,ref:string,tokens:long>>, expanded_tokens long, errors array<string>"


def format_conversations(turns: DataFrame, tokenizer: str | None = None, batch_chars: int = 4_000_000) -> DataFrame:
    """(conv_id, turn, role, parts) -> one row a conversation: n_turns, formatted, loss, attachments, expanded_tokens, errors.

    Rows are dealt by conversation and sorted by turn (then role and content, so that repeated turns have a fixed
    order, and all are kept); a worker streams them and holds one conversation, which is one output row, at a time, however
    long. Null role: empty; null parts, or a null text: empty text; null conv_id: a conversation of its own. A part of an
    unknown type becomes a placeholder of no tokens and a line in errors. An empty table gives no rows; other columns play no part.
    """
    rows = small_batches(turns.select("conv_id", "turn", "role", F.col("parts").cast(f"array<{PART}>").alias("parts")))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(tokenizer)
        done, chars, key, current = [], 0, None, None
        flush = lambda rows: pa.RecordBatch.from_pylist(rows, schema=FORMATTED)
        close = lambda: {"conv_id": key, "n_turns": len(current)} | (r := render(current, count)) | {"loss": [{"start": a, "end": b} for a, b in r["loss"]]}
        for batch in batches:
            for conv, role, parts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "parts")), strict=True):
                if current is not None and conv != key:
                    done.append(close())
                    chars += len(done[-1]["formatted"])
                    current = None
                    if chars > batch_chars:
                        yield flush(done)
                        done, chars = [], 0
                if current is None:
                    key, current = conv, []
                current.append((role or "", parts or []))
        if current is not None:
            done.append(close())
        if done:
            yield flush(done)

    return rows.mapInArrow(work, _DDL)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, from the formatted text alone."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("attachments", pa.int64()), ("expanded_tokens", pa.int64())])

    def work(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text = r["formatted"]
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in r["loss"])
                digest = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
                out.append({"conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": digest, "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text), "attachments": len(r["attachments"]), "expanded_tokens": r["expanded_tokens"]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return formatted.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachments long, expanded_tokens long")



def op6_chat(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    own = spark.sql(r"select -1L conv_id, cast(turn as int) turn, role, '</s>[INST] ok [/INST]' text from values (0, 'user'), (1, 'assistant') as t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), none("string", "ref"), none("int", "width"), none("int", "height"), none("double", "seconds"), none("int", "pages"))
    turns = turns.select(F.col("conv_id").cast("long"), "turn", "role", F.array(part).alias("parts"))
    return read_back(format_conversations(turns, tokenizer=public_tokenizers.path("byte_bpe_50k.json")))
