"""Lock identities as strings kind|root|fields|mode, and their algebra as column functions.

Kinds: t the receiver, p a parameter (root: its number), r an instance of a class,
s a class's static, c a class object, a an allocation site, o unknown (by its site).
Fields are joined by dots, at most ``LONGEST``; mode is empty, read or write.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 3


def part(lock: Column, i: int) -> Column:
    return F.get(F.split(lock, "\\|"), F.lit(i))


def kind(lock: Column) -> Column:
    return F.substring(lock, 1, 1)


def is_opaque(lock: Column) -> Column:
    return kind(lock) == "o"


def is_local(lock: Column) -> Column:
    """No other thread can know it: unknown, or just allocated."""
    return kind(lock).isin("o", "a")


def make(k: Column, root: Column, fields: Column, mode: Column) -> Column:
    return F.concat_ws("|", k, root, fields, mode)


def name(lock: Column) -> Column:
    k, root, fields, mode = (part(lock, i) for i in range(4))
    text = F.when(k == "t", "this").when(k == "p", F.concat(F.lit("$p"), root)).when(k == "c", F.concat(root, F.lit(".class"))).when(k == "a", F.concat(F.lit("new@"), root)).when(k == "o", F.concat(F.lit("?@"), root)).otherwise(root)
    return F.concat(text, F.when(fields != "", F.concat(F.lit("."), fields)).otherwise(""), F.when(mode != "", F.concat(F.lit("."), mode)).otherwise(""))


def extended(lock: Column, fields: Column, mode: Column) -> Column:
    """The path with further fields; its own mode unless the suffix has one; too long a path is unknown, and its own."""
    own = part(lock, 2)
    all_ = F.concat_ws(".", F.when(own != "", own), F.when(fields != "", fields))
    m = F.when(mode != "", mode).otherwise(part(lock, 3))
    whole = make(kind(lock), part(lock, 1), all_, m)
    return F.when((all_ != "") & (F.size(F.split(all_, "\\.")) > LONGEST), F.concat(F.lit("o|trunc:"), F.translate(name(whole), "|", "!"), F.lit("||"))).otherwise(whole)


def bound(lock: Column, args: Column) -> Column:
    """A callee's lock in its caller's terms: the receiver and parameters by the call's arguments (null: unknown), others as they are."""
    at = F.when(kind(lock) == "t", 0).otherwise(part(lock, 1).try_cast("int"))
    arg = F.get(args, at)
    return F.when(kind(lock).isin("t", "p"), F.when(arg.isNotNull(), extended(arg, part(lock, 2), part(lock, 3)))).otherwise(lock)


def grounded(lock: Column, cls: Column, mkey: Column) -> Column:
    """For the whole program: the receiver as an instance of its class, a parameter as unknown."""
    site = F.concat(F.lit("o|"), F.translate(mkey, "|", "!"), F.lit("#p"), part(lock, 1), F.lit("||"))
    return F.when(kind(lock) == "t", make(F.lit("r"), cls, part(lock, 2), part(lock, 3))).when(kind(lock) == "p", site).otherwise(lock)


def plain_name(lock: Column) -> Column:
    """The name without the mode, as aliases are keyed."""
    return name(make(kind(lock), part(lock, 1), part(lock, 2), F.lit("")))


def with_mode(lock: Column, mode: Column) -> Column:
    return make(kind(lock), part(lock, 1), part(lock, 2), mode)


def outer(lock: Column) -> Column:
    """Inner.this$0 as an instance of the outer class."""
    fields, root = part(lock, 2), part(lock, 1)
    inner = (kind(lock) == "r") & ((fields == "this$0") | fields.startswith("this$0.")) & F.contains(root, F.lit("$"))
    rest = F.regexp_replace(fields, r"^this\$0\.?", "")
    return F.when(inner, make(F.lit("r"), F.regexp_replace(root, r"\$[^$]*$", ""), rest, part(lock, 3))).otherwise(lock)
