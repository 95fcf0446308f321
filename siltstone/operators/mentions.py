"""Names in texts: the first entry of a list that mentions any of some names, by one automaton a list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that one task reads against a list's names; longer lists are dealt out, each part with all names.
PART = 20_000


def automaton(names: list[str]) -> tuple[list[dict], list[int], list[list[int]]]:
    """Goto tables, failure links and ends of the trie of some names; ends[s]: the names that end in state s, by their place
    in ``names``, shorter ones through failure links included."""
    goto, fail, ends = [{}], [0], [[]]
    for i, name in enumerate(names):
        state = 0
        for c in name:
            if c not in goto[state]:
                goto[state][c] = len(goto)
                goto.append({})
                fail.append(0)
                ends.append([])
            state = goto[state][c]
        ends[state].append(i)
    level = list(goto[0].values())
    while level:
        below = []
        for state in level:
            for c, child in goto[state].items():
                back = fail[state]
                while back and c not in goto[back]:
                    back = fail[back]
                fail[child] = goto[back].get(c, 0) if goto[back].get(c, 0) != child else 0
                ends[child] += ends[fail[child]]
                below.append(child)
        level = below
    return goto, fail, ends


def _letter(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def mentions(text: str, names: list[str], machine) -> set[int]:
    """Places in ``names`` of those that the text mentions.  A name with :: is mentioned wherever it stands; any other where no
    ASCII letter, digit or _ is before it, and it ends as a word does or a bracket follows."""
    goto, fail, ends = machine
    found, state = set(), 0
    for at, c in enumerate(text):
        while state and c not in goto[state]:
            state = fail[state]
        state = goto[state].get(c, 0)
        for i in ends[state]:
            if i in found:
                continue
            name = names[i]
            if "::" not in name:
                start = at + 1 - len(name)
                after = text[at + 1 :].lstrip()[:1] if at + 1 < len(text) and text[at + 1].isspace() else text[at + 1 : at + 2]
                word_end = _word(c) != (at + 1 < len(text) and _word(text[at + 1]))
                if start and _letter(text[start - 1]) or not (after == "(" or word_end):
                    continue
            found.add(i)
    return found


def match_names(name, aliases):
    """Names that stand for a function, as a column: its own, what follows the last :: of it, and the same of its aliases."""
    tail = lambda n: F.element_at(F.split(n, "::"), -1)
    others = F.flatten(F.transform(F.filter(aliases, lambda a: F.coalesce(a, F.lit("")) != ""), lambda a: F.array(a, tail(a))))
    return F.filter(F.array_distinct(F.concat(F.array(name, tail(name)), F.coalesce(others, F.array().cast("array<string>")))), lambda n: n != "")


def first_mentions(entries: DataFrame, wanted: DataFrame, key: str, part: int = PART) -> DataFrame:
    """(key, name, at, line): for each wanted name the first entry of its list that mentions it or one of its other names.
    entries: (key, at, line); wanted: (key, name, names), see ``match_names``.

    Each line is read once, whatever the number of names.  Names without an entry have no row.  Lines and names that are
    null or empty mention nothing.  Lists of more than ``part`` entries are dealt out with all names, and the least place wins.
    """
    lines = entries.filter(F.col("line").isNotNull() & F.col(key).isNotNull())
    shards = lines.groupBy(key).agg(F.ceil(F.count("*") / part).cast("int").alias("shards"))
    dealt = lines.join(shards, key).select(key, F.pmod(F.xxhash64("at", "line"), F.col("shards")).cast("int").alias("shard"), "at", "line")
    names = wanted.select(key, "name", "names").filter("name is not null").join(shards, key)
    names = names.select(key, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "name", "names")
    key_type, at_type = (entries.schema[c].dataType.simpleString() for c in (key, "at"))

    def find(own, left, right):
        import pandas as pd

        every = sorted({n for ns in right["names"] if ns is not None for n in ns if n})
        of: dict = {n: [] for n in every}
        for name, ns in zip(right["name"], right["names"], strict=True):
            for n in set(ns if ns is not None else ()):
                if n:
                    of[n].append(name)
        machine, best = automaton(every), {}
        for at, line in zip(left["at"], left["line"], strict=True):
            for i in mentions(line, every, machine):
                for name in of[every[i]]:
                    if name not in best or (at, line) < best[name]:
                        best[name] = (at, line)
        return pd.DataFrame([(own[0], name, at, line) for name, (at, line) in best.items()], columns=[key, "name", "at", "line"])

    found = dealt.groupBy(key, "shard").cogroup(names.groupBy(key, "shard")).applyInPandas(find, f"{key} {key_type}, name string, at {at_type}, line string")
    return found.groupBy(key, "name").agg(F.min(F.struct("at", "line")).alias("m")).select(key, "name", "m.at", "m.line")
