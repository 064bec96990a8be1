r"""Chat formatting with a grammar round trip, in native expressions only.

A turn is written as

    ### <role>: <text>\n</turn>\n

and a conversation is its turns one after another. The parser is deterministic: it splits
at "\n</turn>\n", takes the role up to the first ": ", and removes one backslash from every
run of backslashes that stands before a control string ("### " or "</turn>"). In a role
"\b", "\c" and "\l" stand for a backslash, a colon and "<".

Each turn is first written as it is, parsed again and compared with its source. A turn
that does not come back identical is escaped: one more backslash before each control
string, which the parser's rule takes off again, and letters for a role's backslashes,
colons and "<". The comparison is repeated after that,
and then for the whole conversation; a difference there raises an error.

Defined cases: rows of a conversation come by turn, then role and text; null turns come
first. Null texts and roles are empty. Repeated rows are turns of their own. A null id is
one conversation. Other columns are not read; an empty table gives no rows. One output
row holds one conversation, so its size is that of the conversation's text. No pattern
backtracks over more than it has matched, so long texts and roles take linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, STOP = "### ", "\n</turn>\n"
CONTROL = r"### |</turn>"
ASSISTANT = "assistant"
#: What stands for a character in a role; the backslash comes last when it is read.
ROLE_LETTERS = {":": "\\c", "<": "\\l", "\\": "\\b"}


def _escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)(\\*+)({CONTROL})", r"\\$1$2")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*+)({CONTROL})", "$1$2")


def _safe_role(role: Column) -> Column:
    for plain, shown in reversed(ROLE_LETTERS.items()):
        role = F.replace(role, F.lit(plain), F.lit(shown))
    return role


def _read_role(turn: Column) -> Column:
    role = F.substr(F.substring_index(turn, ": ", 1), F.lit(len(HEAD) + 1))
    for plain, shown in ROLE_LETTERS.items():
        role = F.replace(role, F.lit(shown), F.lit(plain))
    return role


def _text_at(turn: Column) -> Column:
    """How many characters come before a turn's text."""
    return F.locate(": ", turn) + 1


def _written(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(": "), text, F.lit(STOP))


def parse(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    parts = F.split(formatted, r"\n</turn>\n")
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            _read_role(t).alias("role"),
            _unescape(F.substr(t, _text_at(t) + 1)).alias("text"),
        ),
    )


def _faithful(role: Column, text: Column, shown_role: Column, shown_text: Column) -> Column:
    back = parse(_written(shown_role, shown_text))
    return (F.size(back) == 1) & (back[0]["role"] == role) & (back[0]["text"] == text)


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and the turn's written form."""
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    safe_role = _safe_role(role)
    plain = _faithful(role, text, role, text)
    raised = _faithful(role, text, safe_role, _escape(text))
    checked = turns.withColumn("plain", plain).withColumn("raised", F.when(F.col("plain"), F.lit(True)).otherwise(raised))
    wrong = F.raise_error(F.concat(F.lit("turn does not come back from its formatted text, conversation "), F.col("conv_id").cast("string")))
    shown = F.when(F.col("plain"), _written(role, text)).when(F.col("raised"), _written(safe_role, _escape(text))).otherwise(wrong)
    return checked.select("conv_id", "turn", "role", "text", shown.alias("shown"))


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans (start and length in code points of each assistant text as written).

    Raises an error if the parser does not give the source turns back.
    """
    turns = format_turns(rows, conv_col, turn_col, role_col, text_col)
    entry = F.struct("turn", "role", "text", "shown")
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("turns"))
    formatted = F.array_join(F.col("turns.shown"), "")
    back = parse(F.col("formatted"))
    same = back == F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    wrong = F.raise_error(F.concat(F.lit("conversation does not come back: "), F.col("conv_id").cast("string")))
    made = grouped.withColumn("formatted", formatted).withColumn("same", same)
    return made.select("conv_id", F.when(F.col("same"), F.col("formatted")).otherwise(wrong).alias("formatted"), _spans(F.col("turns.shown"), F.col("turns.role")).alias("loss_spans"))


def _spans(shown: Column, role: Column) -> Column:
    """Start and length of what follows the head and comes before the stop mark, for assistant turns."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        head = _text_at(x["shown"]).cast("bigint")
        size = F.length(x["shown"]).cast("bigint")
        span = F.struct((acc["at"] + head).alias("start"), (size - head - len(STOP)).alias("length"))
        return F.struct((acc["at"] + size).alias("at"), F.when(x["role"] == ASSISTANT, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(F.arrays_zip(shown.alias("shown"), role.alias("role")), zero, step)["spans"]


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(spans, lambda s: _unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int"))))


def digest(made: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the formatted text."""
    turns = F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = made.withColumn("turns", turns).withColumn("loss", F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
