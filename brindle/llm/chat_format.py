"""Chat formatting of typed content parts, in column expressions only.

A message has a role and a list of parts: text, image, audio or document. A visitor walks the
parts in order and flattens them into one string: text is escaped, any other part becomes a
placeholder that names its place in the conversation's list of attachments. Each attachment is
recorded with its kind, its reference and the number of tokens the model's encoder expands it to
(a fixed number for an image tile, a rate for a second of audio or a page).

Template: a turn is <|start|>role<|message|>body<|end|>, a placeholder <|attach:k|>.
Control strings of this and of other common templates are escaped wherever they occur in a
role, text or reference: a backslash is put behind the first character, behind any that are there
already, so that escaping can be undone exactly. Nothing but the template itself can therefore
begin with "<|", and the formatted string can be read back.

Running numbers (of attachments, and of characters for the loss mask) are window sums over the turns
of a conversation, so the work grows in proportion to its turns. The loss mask is the list of spans
of the assistants' bodies, in code points of the formatted string.

Defined cases: a null text, role or reference is the empty string; a null or empty list of
parts gives an empty body; turns with equal numbers follow by role and parts; repeated rows are
turns of their own; rows without a conversation id form one conversation of null id; an empty
table gives no rows. One conversation is one output row, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template, and the first characters and rests of the control strings to escape.
START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
# No rest holds a first character, so no two of them overlap.
CONTROL = r"(\||/?s>|/?INST\]|/?SYS>|/?think>|/?tool_call>|/?image>|/?audio>|/?document>)"
ESCAPE = rf"([<\[])(\\*){CONTROL}"
UNESCAPE = rf"([<\[])\\(\\*){CONTROL}"

#: Tokens that an attachment expands to, by kind: base + rate * size. A model's own numbers are passed in its place.
EXPANSION = {"image": (85, 170), "audio": (0, 25), "document": (8, 600)}

PART = "struct<type:string,text:string,ref:string,size:bigint>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def text_part(text: Column) -> Column:
    """A single text part, for tables whose messages are plain text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("bigint").alias("size")))


def expanded_tokens(part: Column, expansion: dict[str, tuple[int, int]]) -> Column:
    out = F.lit(0).cast("bigint")
    for kind, (base, rate) in expansion.items():
        out = F.when(part["type"] == kind, F.lit(base) + F.lit(rate) * F.coalesce(part["size"], F.lit(1))).otherwise(out)
    return out.cast("bigint")


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) != "text"


def flattened(parts: Column, first: Column) -> Column:
    """The parts of a message as one string; its attachments are numbered from `first` on, in order. Neighbouring texts are joined
    before they are escaped, so no control string forms across a border of parts."""
    texts = lambda some: escaped(F.array_join(F.transform(some, lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    marks = F.filter(F.transform(parts, lambda p, i: F.when(is_attachment(p), i + 1)), lambda i: i.isNotNull())  # places from 1
    # Run k lies between attachment k - 1 and attachment k, and is followed by that.
    bounds = F.concat(F.array(F.lit(0)), marks, F.array(F.size(parts) + 1))
    between = lambda k: F.slice(parts, F.get(bounds, k) + 1, F.get(bounds, k + 1) - F.get(bounds, k) - 1)
    mark = lambda k: F.when(k + 2 < F.size(bounds), F.concat(F.lit("<|attach:"), (first + k).cast("string"), F.lit("|>"))).otherwise("")
    both = F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda k: F.concat(texts(between(k)), mark(k)))
    return F.when(F.exists(parts, is_attachment), F.array_join(both, "")).otherwise(texts(parts))


def format_messages(messages: DataFrame, by: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", expansion: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """One row for each conversation: its id, n_turns, formatted, attachments
    (array of index, turn, type, ref, expanded_tokens), attachment_tokens and loss_spans (array of start, length).

    messages has a row for each turn with a list of parts (PART). Loss is on assistants' bodies."""
    expansion = EXPANSION if expansion is None else expansion
    m = messages.select(
        F.col(by).alias("c"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts")
    )
    before = Window.partitionBy("c").orderBy("turn", "role", "parts").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda n: F.coalesce(F.sum(n).over(before), F.lit(0)).cast("bigint")
    m = m.withColumn("first", so_far(F.size(F.filter("parts", is_attachment))))
    m = m.select("c", "turn", "role", "parts", F.concat(F.lit(START), escaped(F.col("role")), F.lit(MESSAGE)).alias("head"), flattened(F.col("parts"), F.col("first")).alias("body"))
    m = m.withColumn("start", so_far(F.length("head") + F.length("body") + len(END)))
    found = F.transform(F.filter("parts", is_attachment), lambda p: F.struct(F.col("turn").alias("turn"), p["type"].alias("type"), F.coalesce(p["ref"], F.lit("")).alias("ref"), expanded_tokens(p, expansion).alias("expanded_tokens")))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("start") + F.length("head")).alias("start"), F.length("body").cast("bigint").alias("length")))
    # Every turn has characters, so no two turns of a conversation start at one place.
    g = m.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("start", F.concat("head", "body", F.lit(END)).alias("s"), found.alias("found"), span.alias("span")))).alias("m"))
    g = g.select(
        F.col("c").alias(by),
        F.size("m").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("m", lambda x: x["s"]), "").alias("formatted"),
        F.transform(F.flatten(F.transform("m", lambda x: x["found"])), lambda a, k: F.struct(k.alias("index"), a["turn"].alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["expanded_tokens"].alias("expanded_tokens"))).alias("attachments"),
        F.array_compact(F.transform("m", lambda x: x["span"])).alias("loss_spans"),
    )
    return g.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["expanded_tokens"]))


def turns_of(formatted: Column) -> Column:
    """Read a formatted string back: array of (role, body), unescaped. Placeholders stay in the bodies."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.regexp_replace(F.substring_index(p, MESSAGE, 1), r"^<\|start\|>", "")).alias("role"),
            unescaped(F.substring_index(p, MESSAGE, -1)).alias("text"),
        ),
    )


def loss_text(formatted: Column) -> Column:
    """What lies under the loss mask, read back from the formatted string: the bodies of assistants, unescaped, nothing
    between. One pass over the string; cutting its spans out one by one would walk it from the beginning for each."""
    head = f"{START}assistant{MESSAGE}"
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p.startswith(head))
    return F.array_join(F.transform(pieces, lambda p: unescaped(p.substr(F.lit(len(head) + 1), F.length(p)))), "")
