from __future__ import annotations

import os

import duckdb

#: Several words that no two of these texts share in a row.
WORDS = [f"{a}{b}" for a in ("ka", "mo", "ri", "tus", "vel") for b in ("ran", "dil", "pos", "qua", "sem", "lor", "nik", "bat")]


def prose(seed: int, words: int) -> str:
    out, state = [], seed * 7919 + 13
    for k in range(words):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(WORDS[state // 65536 % len(WORDS)] + ("." if k % 9 == 8 else ""))
    return " ".join(out)


def rows() -> list[tuple]:
    """doc_id, text, lang, source: nulls, empty and long texts, copies, near copies, one id with two texts, repeated rows."""
    base = [(k, prose(k, 60 + 7 * k), ("en", "de")[k % 2], f"s{k % 3}") for k in range(24)]
    near = prose(3, 81).split()
    near[40] = "changed"
    base += [(100, prose(3, 81), "en", "s0"), (101, " ".join(near), "en", None), (102, prose(3, 81).upper(), None, "s1")]
    base += [(103, prose(50, 40) + "\n" + prose(4, 88)[:260] + "\n" + prose(51, 40), "de", "s2")]
    base += [(104, None, "en", "s0"), (105, "", "en", "s0"), (106, " \n\t ", None, None), (107, "one two", "de", "s1"), (108, "one two", "de", "s1")]
    base += [(109, prose(60, 9000), "en", "s0"), (110, "x" * 9000, "en", "s2"), (111, "línea única ñandú — 中文字符 😀" * 5, "de", "s0")]
    base += [(112, prose(70, 70), "en", "s1"), (112, prose(71, 70), "en", "s1"), (113, prose(72, 70), "en", "s1"), (113, prose(72, 70), "en", "s1")]
    base += [(None, prose(73, 70), "en", "s1"), (None, None, None, None), (114, "12 34 !! ##", "en", "s2"), (115, ("menu | home | login\n" * 30), "en", "s0")]
    return base


CLASHES = "size bigint, score string, taken string, node string, part int, n bigint, kept string, tail int, target int, text_2 string"


def sql_rows(folder: str, sql: str, columns: list[str]) -> list[tuple]:
    con = duckdb.connect()
    for name in ("documents", "labels", "pages"):
        path = f"{folder}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    names = ", ".join(columns)
    return sorted(con.execute(f"SELECT {names} FROM ({sql})").fetchall(), key=repr)


def spark_rows(df, columns: list[str] | None = None) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(columns or df.columns).collect()), key=repr)
