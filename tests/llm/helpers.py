"""Frames and brute-force counterparts for the tests of this folder."""

import re

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width=5):
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def components(nodes, links):
    """Smallest node reachable, by plain search."""
    near = {n: set() for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    found = {}
    for n in sorted(nodes):
        if n in found:
            continue
        stack = [n]
        while stack:
            x = stack.pop()
            if x not in found:
                found[x] = n
                stack.extend(near[x])
    return found


def documents(spark, rows, extra=True):
    """(doc_id, text) rows as a table with more columns, some named like those that operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, "en", "src0", 0) for i, t in rows]
    df = spark.createDataFrame(full, schema)
    if extra:
        from pyspark.sql import functions as F
        for name in ("score", "size", "draw", "row", "own", "range", "set_id", "next_text", "sketch", "key", "a", "b"):
            df = df.withColumn(name, F.lit(-1))
    return df
