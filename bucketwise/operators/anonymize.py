"""Deterministic scrubbing of personal data, as native column expressions.

A processor looks at a field (name, column, type) and returns a new column, or
``DROP`` to remove the field. A chain applies processors from left to right. The
walk over nested structs, arrays and maps happens on the schema while the plan is
built; rows are handled by generated code only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.functions.fields import quote


class _Drop:
    def __repr__(self) -> str:
        return "DROP"


DROP = _Drop()


@dataclass(frozen=True)
class Value:
    """One field on its way through a chain."""

    name: str
    col: Column
    dtype: T.DataType
    # Set inside maps and variants, where the field name is a value: rules by name become conditions.
    key: Column | None = None

    @property
    def is_text(self) -> bool:
        return isinstance(self.dtype, T.StringType)

    def text(self, col: Column) -> "Value":
        return Value(self.name, col, T.StringType(), self.key)


Processor = Callable[[Value], "Value | _Drop"]


def chain(*processors: Processor | None) -> Processor:
    """Left to right; the first drop ends the chain."""
    def run(value: Value):
        for p in processors:
            if p is None:
                continue
            value = p(value)
            if value is DROP:
                return DROP
        return value

    for kind in _NAMES:
        setattr(run, kind, frozenset().union(*(names_of(p, kind) for p in processors if p is not None)))
    return run


# What a processor says about field names: which it drops, replaces as a whole, or has a rule for (in lower case).
_NAMES = ("dropped", "cut", "ruled")


def names_of(p: Processor, kind: str) -> frozenset[str]:
    return getattr(p, kind, frozenset())


def custom(fn: Callable[[str, Column], "Column | _Drop"]) -> Processor:
    """A user rule over text fields: ``fn(name, column)`` returns a column or DROP."""
    def run(value: Value):
        if not value.is_text:
            return value
        out = fn(value.name, value.col)
        return DROP if out is DROP else value.text(out)

    return run


# -- walking rows -------------------------------------------------------------------

_SCALARS = (T.StringType, T.NumericType, T.BooleanType)


def _walk(value: Value, p: Processor):
    """Apply ``p`` to a field and then to everything inside it."""
    out = p(value)
    if out is DROP:
        return DROP
    dtype = out.dtype
    if isinstance(dtype, T.StructType):
        return _walk_struct(out, dtype, p)
    if isinstance(dtype, T.ArrayType):
        return _walk_array(out, dtype, p)
    if isinstance(dtype, T.MapType):
        return _walk_map(out, dtype, p)
    if isinstance(dtype, T.VariantType):
        return _walk_variant(out, p)
    return out


def _walk_struct(value: Value, dtype: T.StructType, p: Processor):
    fields, types = [], []
    for f in dtype.fields:
        inner = _walk(Value(f.name, value.col.getField(f.name), f.dataType), p)
        if inner is not DROP:
            fields.append(inner.col.alias(f.name))
            types.append(T.StructField(f.name, inner.dtype, True))
    if not fields:
        return DROP
    rebuilt = F.when(value.col.isNotNull(), F.struct(*fields))
    return Value(value.name, rebuilt, T.StructType(types), value.key)


def _walk_array(value: Value, dtype: T.ArrayType, p: Processor):
    probe = _walk(Value(value.name, F.lit(None), dtype.elementType, value.key), p)
    if probe is DROP:
        nothing = F.when(value.col.isNotNull(), F.array().cast(T.ArrayType(dtype.elementType)))
        return Value(value.name, nothing, dtype, value.key)

    def item(x: Column) -> Column:
        return _walk(Value(value.name, x, dtype.elementType, value.key), p).col

    return Value(value.name, F.transform(value.col, item), T.ArrayType(probe.dtype), value.key)


_NODE = "struct<path:string,lead:string,name:string,value:variant>"
_MARK = "struct<path:string,text:string>"


def _walk_variant(value: Value, p: Processor):
    """Schemaless values, to any depth.

    A value is taken apart level by level. Each node has a path that sorts like the order of the JSON text, the text
    that leads to it, and the name of the field it belongs to (items of an array have that of the array). The chain stands
    in the plan once, over all leaves; their texts and the brackets, in the order of the paths, are the new JSON.
    """
    probe = p(Value(value.name, F.lit(None).cast("string"), T.StringType(), F.lit(value.name) if value.key is None else value.key))
    if probe is DROP:
        return DROP
    dropped, cut, ruled = (sorted(names_of(p, kind)) for kind in _NAMES)

    def known(name: Column, names: list[str]) -> Column:
        return F.coalesce(name.isin(*names), F.lit(False)) if names else F.lit(False)

    def node(path: Column, lead: Column, name: Column, inner: Column) -> Column:
        return F.struct(path.alias("path"), lead.alias("lead"), name.alias("name"), inner.alias("value"))

    def opened(n: Column) -> Column:
        whole = known(n["name"], cut)
        members = F.filter(F.map_entries(n["value"].try_cast("map<string,variant>")), lambda m: ~known(m["key"], dropped))
        return F.struct(n.alias("node"), F.when(~whole, members).alias("members"),
                        F.when(~whole, n["value"].try_cast("array<variant>")).alias("items"))

    def children(e: Column) -> Column:
        n = e["node"]
        step = lambda i: F.concat(n["path"], F.lpad(i.cast("string"), 9, "0"))
        comma = lambda i: F.when(i > 0, F.lit(",")).otherwise(F.lit(""))
        named = F.transform(e["members"], lambda m, i: node(
            step(i), F.concat(comma(i), F.to_json(m["key"].cast("variant")), F.lit(":")), m["key"], m["value"]))
        items = F.transform(e["items"], lambda x, i: node(step(i), comma(i), n["name"], x))
        return F.coalesce(named, items)

    def brackets(e: Column) -> Column:
        n, named = e["node"], e["members"].isNotNull()
        begin = F.struct(n["path"].alias("path"), F.concat(n["lead"], F.when(named, "{").otherwise("[")).alias("text"))
        end = F.struct(F.concat(n["path"], F.lit("~")).alias("path"), F.when(named, "}").otherwise("]").alias("text"))
        return F.array(begin, end)

    def level(state: Column) -> Column:
        def split(nodes: Column) -> Column:
            inner = F.filter(nodes, lambda e: e["members"].isNotNull() | e["items"].isNotNull())
            ends = F.filter(nodes, lambda e: e["members"].isNull() & e["items"].isNull())
            return F.struct(F.flatten(F.transform(inner, children)).alias("open"),
                            F.concat(state["leaves"], F.transform(ends, lambda e: e["node"])).alias("leaves"),
                            F.concat(state["marks"], F.flatten(F.transform(inner, brackets))).alias("marks"))

        return F.when(F.size(state["open"]) == 0, state).otherwise(let(F.transform(state["open"], opened), split))

    def leaf(n: Column) -> Column:
        kind = F.schema_of_variant(n["value"])
        as_text = known(n["name"], cut) | ((kind == "STRING") | known(F.lower(n["name"]), ruled)) & (kind != "VOID")
        out = p(Value(value.name, n["value"].try_cast("string"), T.StringType(), n["name"]))
        written = F.coalesce(F.to_json(out.col.cast("string").cast("variant")), F.lit("null"))
        return F.struct(n["path"].alias("path"), F.concat(n["lead"], F.when(as_text, written).otherwise(F.to_json(n["value"]))).alias("text"))

    name = F.lit(value.name) if value.key is None else value.key
    begin = F.struct(F.array(node(F.lit(""), F.lit(""), name, value.col)).alias("open"),
                     F.array().cast(f"array<{_NODE}>").alias("leaves"), F.array().cast(f"array<{_MARK}>").alias("marks"))
    # No value is deeper than it has opening brackets; levels without nodes cost next to nothing.
    depth = F.length(F.regexp_replace(F.to_json(value.col), r"[^\[{]", "")) + 1
    walked = F.aggregate(F.sequence(F.lit(1), depth), begin, lambda state, _: level(state))

    def joined(state: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(F.concat(state["marks"], F.transform(state["leaves"], leaf))), lambda m: m["text"]), "")

    return Value(value.name, F.when(value.col.isNotNull(), F.parse_json(let(walked, joined))), T.VariantType(), value.key)


def _walk_map(value: Value, dtype: T.MapType, p: Processor):
    probe = _walk(Value("", F.lit(None), dtype.valueType, F.lit("")), p)
    if probe is DROP:
        return value

    def entry(k: Column, v: Column) -> Column:
        return _walk(Value("", v, dtype.valueType, k.cast("string")), p).col

    kept, dropped = value.col, sorted(names_of(p, "dropped"))
    if dropped:  # inside a map a name is data, so the entry goes by a filter
        kept = F.map_filter(kept, lambda k, _: ~k.cast("string").isin(dropped))
    return Value(value.name, F.transform_values(kept, entry),
                 T.MapType(dtype.keyType, probe.dtype), value.key)


def dealt(df: DataFrame, rows_per_task: int = 10_000) -> DataFrame:
    """Rows in even parts of about so many; deal out few columns, before others are derived from them.

    Scrubbing a row costs far more than reading it, but a file's row group, which may hold a million rows, is read
    by one task. The rows are counted first; a file's footer has their number.
    """
    return df.repartition(max(1, -(-df.count() // rows_per_task)))


def anonymize(df: DataFrame, p: Processor, keep: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Scrub every field of every row; ``keep`` names columns left alone.

    ``partitions`` deals the rows out first, for an input of few files that can't be split.
    """
    if partitions:
        df = df.repartition(partitions)
    columns = []
    for f in df.schema.fields:
        if f.name in keep:
            columns.append(F.col(quote(f.name)))
            continue
        out = _walk(Value(f.name, F.col(quote(f.name)), f.dataType), p)
        if out is not DROP:
            columns.append(out.col.alias(f.name))
    return df.select(*columns)


def apply_by_name(name: Column, value: Column, names: Sequence[str], dtype: T.DataType, p: Processor) -> Column:
    """Scrub a long table of (field name, value): each name gets its own rule."""
    result = None
    for n in names:
        out = _walk(Value(n, value, dtype), p)
        masked = F.lit(None).cast(dtype) if out is DROP else out.col
        result = F.when(name == n, masked) if result is None else result.when(name == n, masked)
    return value if result is None else result.otherwise(value)


# -- rules by field name --------------------------------------------------------------

def by_column(rules: Mapping[str, Callable[[Column], Column]]) -> Processor:
    """Replace the values of named fields (any case); other types become text first.

    Empty texts stay as they are.
    """
    lowered = {k.lower(): rule for k, rule in rules.items()}
    # Names of one rule are tested together, so a rule stands in the plan once.
    shared: dict[int, tuple[Callable[[Column], Column], list[str]]] = {}
    for name, rule in lowered.items():
        shared.setdefault(id(rule), (rule, []))[1].append(name)

    def by_key(key: Column, text: Column) -> Column:
        out = F.when(F.coalesce(text == "", F.lit(True)), text)
        for rule, names in shared.values():
            out = out.when(key.isin(*names), rule(text))
        return out.otherwise(text)

    def run(value: Value):
        if not isinstance(value.dtype, _SCALARS):
            return value
        if value.key is not None:
            if not value.is_text:
                return value
            return value.text(let(value.col, lambda text: by_key(F.lower(value.key), text)) if shared else value.col)
        rule = lowered.get(value.name.lower())
        if rule is None:
            return value
        text = value.col.cast("string")
        return value.text(F.when(text != "", rule(text)).otherwise(text))

    run.ruled = frozenset(lowered)
    return run


def replace_with(text: str) -> Callable[[Column], Column]:
    return lambda _: F.lit(text)


def drop_fields(*names: str) -> Processor:
    """Remove fields by exact name, at any depth, also in maps and variants."""
    def run(value: Value):
        return DROP if value.key is None and value.name in run.dropped else value

    run.dropped = frozenset(names)
    return run


TRUNCATED = "<TRUNCATED>"


def truncate_fields(*names: str) -> Processor:
    """Replace the whole value of fields by a marker."""
    cut = set(names)

    def run(value: Value):
        if value.key is not None:
            if not value.is_text:
                return value
            return value.text(F.when(value.key.isin(*cut), F.lit(TRUNCATED)).otherwise(value.col))
        return value.text(F.lit(TRUNCATED)) if value.name in cut else value

    run.cut = frozenset(names)
    return run


def text_pattern(pattern: str, replacement: str, needs: str | None = None) -> Processor:
    """Replace every match of a regular expression in text fields.

    ``needs`` is a literal every match contains; texts without it skip the pattern.
    """
    def replaced(text: Column) -> Column:
        out = F.regexp_replace(text, pattern, replacement)
        return F.when(text.contains(needs), out).otherwise(text) if needs else out

    def run(value: Value):
        if not value.is_text:
            return value
        return value.text(let(value.col, replaced) if needs else replaced(value.col))

    return run


# -- scrambling -------------------------------------------------------------------------

# The linear congruential generator behind scrambled characters.
_MULTIPLIER, _INCREMENT, _MASK = 1103515245, 12345, 0x7FFFFFFF
# Characters handled per generator block. Inside a block every state is a linear
# function of the block's first state, so blocks need no character-wise loop.
_BLOCK = 128


def _block_coefficients(size: int) -> tuple[list[int], list[int], list[int]]:
    """For step j of a block starting at index i with state s, the state is
    a[j] * s + b[j] + c[j] * i (masked)."""
    a, b, c = [1], [0], [0]
    for j in range(size):
        a.append(a[-1] * _MULTIPLIER & _MASK)
        b.append((b[-1] * _MULTIPLIER + _INCREMENT + j) & _MASK)
        c.append((c[-1] * _MULTIPLIER + 1) & _MASK)
    return a, b, c


def _jump_coefficients(size: int, bits: int = 31) -> list[tuple[int, int, int]]:
    """(a, c, b) for jumps over 1, 2, 4, ... blocks: from state s at index i to a * s + c * i + b (masked)."""
    a, b, c = (values[size] for values in _block_coefficients(size))
    out, distance = [], size
    for _ in range(bits):
        out.append((a, c, b))
        a, c, b = a * a & _MASK, (a * c + c) & _MASK, (a * b + c * distance + b) & _MASK
        distance = 2 * distance & _MASK
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _constants(values: Sequence[int]) -> Column:
    """One literal, folded into a constant array by the optimizer."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast("array<bigint>")


def _masked(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_MASK))


def scramble(text: Column) -> Column:
    """Other letters for letters, other digits for digits; everything else stays.

    The same text always gives the same result. Work grows linearly with the text (times the logarithm of
    its number of blocks); the state before a block follows from the block's number alone.
    """
    steps = [values[1:] for values in _block_coefficients(_BLOCK)]  # at j: the state at the block's character j
    a, b, c = _constants(steps[0]), _constants(steps[1]), _constants([value * _BLOCK & _MASK for value in steps[2]])
    jump_a, jump_c, jump_b = map(_constants, zip(*_jump_coefficients(_BLOCK), strict=True))
    seed = _masked(F.crc32(text.cast("binary")))
    # Most names and addresses are one block, which is neither cut out nor jumped to.
    blocks = F.when(F.length(text) <= _BLOCK, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)))

    # Factors stay below 2**31, so a product fits, and so does its sum with terms below 2**31.
    def step(state: Column, j: Column, number: Column) -> Column:
        return _masked(_masked(F.get(a, j) * state) + F.get(c, j) * number + F.get(b, j))

    def state_of(first: Column, number: Column) -> Column:
        """The state before a block: one jump for every bit of its number."""
        def jump(at: Column, bit: Column) -> Column:
            there = _masked(_masked(F.get(jump_a, bit) * at["state"]) + _masked(F.get(jump_c, bit) * at["index"]) + F.get(jump_b, bit))
            ahead = F.struct(there.alias("state"), (at["index"] + F.call_function("shiftleft", F.lit(_BLOCK).cast("long"), bit)).alias("index"))
            return F.when(F.getbit(number, bit) == 1, ahead).otherwise(at)

        bits = F.sequence(F.lit(0), F.length(F.bin(number)) - 1)
        return F.aggregate(bits, F.struct(first.alias("state"), F.lit(0).cast("long").alias("index")), jump, lambda at: at["state"])

    def one_block(first: Column, block: Column, i: Column) -> Column:
        return let(F.when(i == 0, first).otherwise(state_of(first, i)), lambda state: F.array_join(F.transform(
            F.split(block, ""), lambda ch, j: _letter(ch, step(state, j, i))), ""))

    return F.when(text == "", text).otherwise(
        let(seed, lambda first: F.array_join(F.transform(blocks, lambda block, i: one_block(first, block, i)), "")))


def _letter(char: Column, state: Column) -> Column:
    """Another character of the same class, chosen by the generator's state."""
    def other(first: str, size: int) -> Column:
        return F.char(state % size + ord(first))

    lower, upper, digit = other("a", 26), other("A", 26), other("0", 10)
    return (
        F.when(char.between("a", "z"), lower)
        .when(char.between("A", "Z"), upper)
        .when(char.between("0", "9"), digit)
        .when(F.octet_length(char) == 1, char)
        .when(char.rlike(r"^\p{Lu}$"), upper)
        .when(char.rlike(r"^\p{Ll}$"), lower)
        .when(char.rlike(r"^\p{Nd}$"), digit)
        .otherwise(char))


def scramble_ip(text: Column) -> Column:
    """A stable pseudo address of the same family; unspecified addresses stay."""
    crc = F.crc32(text.cast("binary"))
    octets = [F.shiftright(crc, s).bitwiseAND(F.lit(0xFF)).cast("string") for s in (24, 16, 8, 0)]
    segments = F.transform(
        F.split(text, ":"),
        lambda seg, i: F.when(seg == "", F.lit("")).otherwise(F.lower(F.lpad(F.hex(
            F.crc32(F.concat(text, F.lit(":"), i.cast("string")).cast("binary")).bitwiseAND(F.lit(0xFFFF))),
            4, "0"))))
    return (
        F.when(text.isin("", "0.0.0.0", "::"), text)
        .when(text.contains(":"), F.array_join(segments, ":"))
        .when(text.contains("."), F.concat_ws(".", *octets))
        .otherwise(text))


# -- secrets ----------------------------------------------------------------------------

SECRET = "<SECRET>"
# Characters that end a token.
_SPACE = "\\t\\n\\f\\r "


def _byte_list(token: Column) -> Column:
    """The token's bytes as two-digit hex texts."""
    return F.regexp_extract_all(F.hex(token.cast("binary")), F.lit("(..)"), F.lit(1))


def _entropy_of(codes: Column) -> Column:
    n = F.size(codes).cast("double")

    def term(acc: Column, code: Column) -> Column:
        share = F.size(F.filter(codes, lambda x: x == code)) / n
        return acc - share * F.log2(share)

    return F.aggregate(F.array_distinct(codes), F.lit(0.0), term)


def shannon_entropy(text: Column) -> Column:
    """Bits per byte."""
    return F.when(text == "", F.lit(0.0)).otherwise(let(_byte_list(text), _entropy_of))


def redact_random_tokens(threshold: float, min_bytes: int) -> Processor:
    """Replace tokens that look random: long enough and of high entropy.

    Entropy above ``threshold`` needs at least 2**threshold different bytes. Only
    texts that hold a token of that size are taken apart.
    """
    different = max(1, math.ceil(2 ** threshold - 1e-9))
    needed = max(min_bytes, different)
    token_or_space = F.lit(f"[^{_SPACE}]+|[{_SPACE}]+")

    def looks_random(codes: Column) -> Column:
        return (F.size(F.array_distinct(codes)) >= different) & (_entropy_of(codes) >= threshold)

    def redacted(token: Column) -> Column:
        random = (F.octet_length(token) >= needed) & let(_byte_list(token), looks_random)
        return F.when(random, F.lit(SECRET)).otherwise(token)

    def cleaned(text: Column) -> Column:
        # A long token shows as a run of characters, shorter where characters take
        # several bytes.
        run = lambda width: text.rlike(f"[^{_SPACE}]{{{-(-needed // width)}}}")
        candidate = (
            F.when(F.octet_length(text) == F.length(text), run(1))
            .when(text.rlike("[^\\x{0}-\\x{FFFF}]"), run(4))
            .when(text.rlike("[^\\x{0}-\\x{7FF}]"), run(3))
            .otherwise(run(2)))
        pieces = F.regexp_extract_all(text, token_or_space, F.lit(0))
        return F.when(candidate, F.array_join(F.transform(pieces, redacted), "")).otherwise(text)

    return lambda value: value.text(let(value.col, cleaned)) if value.is_text else value


# -- default rules ------------------------------------------------------------------------

def _run_before(chars: str, mark: str) -> str:
    """``[chars]+mark``, started only at the beginning of a run of such characters.

    Finds the same matches as the plain pattern but never retries inside a long run,
    so its cost stays linear in the text.
    """
    return f"(?:\\G|(?<![{chars}]))[{chars}]++{mark}"


_WORD = "0-9A-Za-z_"
# Word boundaries on ASCII letters, digits and underscore. The one at the beginning is
# tested after a first matching character, which rules out most positions cheaply.
_BEGUN, _END = f"(?<![{_WORD}].)", f"(?![{_WORD}])"
_HEX = "0-9a-fA-F"
_DOMAIN = "[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}"

# What the default rules look for and put in place.
EMAIL = (_run_before("a-zA-Z0-9._%+\\-", "@") + _DOMAIN, "<EMAIL>", "@")
EMAIL_ENCODED = (_run_before("a-zA-Z0-9._+\\-", "%40") + _DOMAIN, "<EMAIL>", "%40")
IPV4 = (f"\\d{_BEGUN}\\d{{0,2}}\\.(?:\\d{{1,3}}\\.){{2}}\\d{{1,3}}{_END}", "<IP>", ".")
IPV6 = (f"[{_HEX}]{_BEGUN}[{_HEX}]{{0,3}}:(?:[{_HEX}]{{1,4}}:){{6}}[{_HEX}]{{1,4}}{_END}", "<IP6>", ":")
IBAN = (f"[A-Z]{_BEGUN}[A-Z]\\d{{2}}[A-Z0-9]{{4}}\\d{{7,}}{_END}", "<IBAN>", None)
PATTERNS = (EMAIL, EMAIL_ENCODED, IPV4, IPV6, IBAN)

EMAIL_COLUMNS = ("email", "user_email", "email_address")
IP_COLUMNS = ("ip", "ip_address", "remote_addr", "remote_ip", "client_ip", "request__remote_ip",
              "request__client_ip", "x_forwarded_for")
NAME_COLUMNS = ("username", "user_name", "full_name", "first_name", "last_name")
AGENT_COLUMNS = ("user_agent",)
ENTROPY_BITS, ENTROPY_BYTES = 4.8, 12


def default_rules() -> Processor:
    """Known personal columns, then patterns in free text, then random-looking tokens."""
    rules: dict[str, Callable[[Column], Column]] = {}
    rules.update({name: scramble for name in (*EMAIL_COLUMNS, *NAME_COLUMNS)})
    rules.update({name: scramble_ip for name in IP_COLUMNS})
    rules.update({name: replace_with("REDACTED") for name in AGENT_COLUMNS})
    return chain(
        by_column(rules),
        *[text_pattern(*rule) for rule in PATTERNS],
        redact_random_tokens(ENTROPY_BITS, ENTROPY_BYTES),
    )
