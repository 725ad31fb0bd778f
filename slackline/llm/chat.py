"""Chat formatting with compiled templates, and reading the format back.

A conversation's rows are brought together by a shuffle on conv_id and sorted by turn inside the
partition; a worker then renders turn by turn as rows stream by. A long conversation comes out as
segments of whole turns, and what is read back is digested segment by segment, so neither holds more
than a segment and a turn, however many turns a conversation has.

Control strings inside roles and texts are escaped with a backslash: a backslash is doubled, and the
first letter of a control string is written as a backslash and a letter of its own. No control
string is left, and ``unescape`` gives the text back.

Defined cases: null text and null role are empty; null conv_id is a conversation of its own; null
turns come first; rows of equal turn go in order of role and text; repeated rows are turns each; an
empty table gives nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.llm.template import compile_template

#: The strings that mean something to chat formats in use.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: What stands for the first letter of a control string.
LETTERS = {"<": "l", "[": "b", "|": "p"}

TURN = (
    "{% if first %}<s>{% endif %}<|turn|>{{ role | escape }}<|says|>"
    "{% if role == 'assistant' %}{% generation %}{{ text | escape }}{% endgeneration %}{% else %}{{ text | escape }}{% endif %}"
    "<|end|>{{ '\\n' }}"
)
_OPEN = re.compile("|".join(["\\\\", *(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL)]))
_SHUT = re.compile(r"\\(.)", re.S)
_BACK = {v: k for k, v in LETTERS.items()} | {"\\": "\\"}
_READ = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _OPEN.sub(lambda m: "\\" + LETTERS.get(m[0], "\\"), text)


def unescape(text: str) -> str:
    return _SHUT.sub(lambda m: _BACK[m[1]], text)


#: Characters after which a segment ends with its turn.
SEGMENT = 4_000_000


@dataclass
class Formatted:
    """What a conversation's turns became: a segment's text, and the spans of it that are to be learnt."""

    parts: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    length: int = 0

    def add(self, parts: list[tuple[str, bool]]) -> None:
        for text, generated in parts:
            if generated:
                if self.spans and self.spans[-1][1] == self.length:
                    self.spans[-1] = (self.spans[-1][0], self.length + len(text))
                else:
                    self.spans.append((self.length, self.length + len(text)))
            self.parts.append(text)
            self.length += len(text)

    def text(self) -> str:
        return "".join(self.parts)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _READ.finditer(formatted)]


def format_conversations(rows: DataFrame, turn_template: str = TURN, segment: int = SEGMENT) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` to conv_id, segment (from 0), formatted, loss_starts, loss_ends (code points in the segment); segments in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(turn_template, {"escape": escape})
        names = ["conv_id", "segment", "formatted", "loss_starts", "loss_ends"]
        done: list[tuple] = []
        size, now, n, made = 0, None, 0, Formatted()

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(done, columns=names)
            out["conv_id"] = out["conv_id"].astype("Int64")
            done.clear()
            return out

        for batch in batches:
            for conv, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                key = (None if pd.isna(conv) else int(conv),)
                if now is not None and (key != now or made.length >= segment):
                    done.append((now[0], n, made.text(), [a for a, _ in made.spans], [b for _, b in made.spans]))
                    size += made.length
                    made, n = Formatted(), n + 1 if key == now else 0
                    if size > segment:
                        yield frame()
                        size = 0
                made.add(render({"role": role, "text": text, "first": key != now}))
                now = key
        if now is not None:
            done.append((now[0], n, made.text(), [a for a, _ in made.spans], [b for _, b in made.spans]))
        yield frame()

    rows = rows.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.drop("turn").mapInPandas(run, "conv_id long, segment int, formatted string, loss_starts array<int>, loss_ends array<int>")


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """conv_id and digests of what the formatted text and its loss spans say.

    ``in_order``: the segments come straight from ``format_conversations``, not from a table.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = said = learnt = None
        turns = chars = length = 0

        def close(out: list[tuple]) -> None:
            if now is not None:
                out.append((now[0], turns, said.hexdigest(), chars, learnt.hexdigest(), length))

        def frame(out: list[tuple]) -> pd.DataFrame:
            made = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            made["conv_id"] = made["conv_id"].astype("Int64")
            return made

        for batch in batches:
            out: list[tuple] = []
            for conv, text, starts, ends in zip(*(batch[c] for c in ("conv_id", "formatted", "loss_starts", "loss_ends")), strict=True):
                key = (None if pd.isna(conv) else int(conv),)
                if key != now:
                    close(out)
                    now, said, learnt, turns, chars, length = key, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, words in read_turns(text):
                    said.update(f"{role}\n{words}\n".encode("utf-8", "surrogatepass"))
                    turns += 1
                for a, b in zip(starts, ends, strict=True):
                    words = unescape(text[a:b])
                    chars += len(words)
                    learnt.update(words.encode("utf-8", "surrogatepass"))
                length += len(text)
            yield frame(out)
        out = []
        close(out)
        yield frame(out)

    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(probe)), in_order=True)


_ESCAPED = "coalesce(text, '')"
for _c in ("\\", *CONTROL):  # in the order that escape() gives way in: backslashes first, then each control string's first letter
    _ESCAPED = "replace({}, '{}', '{}')".format(_ESCAPED, _c, "\\\\" if _c == "\\" else "\\" + LETTERS[_c[0]] + _c[1:])
OP4_SQL = f"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {_ESCAPED} AS escaped FROM (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(3 + sum(length('<|turn|><|says|><|end|>') + 1 + length(role) + length(escaped)) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""
