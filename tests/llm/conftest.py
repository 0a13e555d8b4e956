"""Small tables with every awkward row: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

WORDS = "the and attion thanedble idiot ention ouing leaux çouelle ñaré größe API token ha re nd that scum".split()


def make_rows(seed=3, n=160):
    rng = random.Random(seed)

    def prose(k):
        out = []
        for _ in range(k):
            w = rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choices("abcdeéñürst", k=rng.randint(2, 9)))
            out.append(w + rng.choice(["", "", "", ",", ".", "\n", " "]))
        return " ".join(out)

    rows = []
    for i in range(n):
        text = prose(rng.choice([1, 3, 4, 5, 30, 60, 120, 200]))
        if i % 13 == 0:
            text += ' API_KEY = "' + "".join(rng.choices("0123456789abcdef", k=40)) + '" AKIA' + "Q7" * 9 + " tail"
        if i % 17 == 0:
            text += "\nLicensed under the Apache License, Version 2.0. MIT license; the GNU General Public License"
        if i % 19 == 0:
            text = "spam " * 80
        if i % 23 == 0:
            text = rows[-1][1] if rows else text
        rows.append((i * 3, text, rng.choice(["en", "fr", None]), rng.choice(["src0", "src0", "src1", "ß", None])))
    rows += [(9001, None, "en", "src1"), (9002, "", "en", "src1"), (9003, " \n\t ", None, None), (None, "no id at all here", "en", "src0")]
    rows += [(9004, "x" * 3000 + " " + prose(3000), "en", "src0"), (9005, "One. 😀 two three four\x1cfive's don't  \n\n end ", "en", "src0")]
    rows += [rows[5], rows[5], rows[7]]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in rows]


TURNS = "conv_id long, turn long, role string, text string, fault string, key int"


def make_turns(seed=4, n=150):
    """Conversations of 0 to 9 turns, some alike, with gaps, ties, nulls, odd roles and repeated rows, and columns named as results are."""
    rng = random.Random(seed)
    said = ["Yes.", "No", "Why?", " ", "", "Well, yes!  ", "é\x1c", "no.\n", "One two three."]
    rows = []
    for c in range(n):
        turns = range(rng.randint(1, 9))
        plain = rng.random() < 0.5
        for t in turns:
            role = ("system", "user")[t == 0 or rng.random() < 0.8] if t == 0 else ("assistant", "user")[t % 2 == 0]
            if not plain and rng.random() < 0.3:
                role = rng.choice(["user", "assistant", "system", "tool", "", None, "umpire"])
            text = f"{rng.choice(said)}" if rng.random() < 0.5 else f"turn {t} of {rng.randint(0, 2)}."
            if not plain and rng.random() < 0.1:
                text = None
            number = None if not plain and rng.random() < 0.1 else t + (rng.random() < 0.1)
            rows.append((c * 2 - 4 if c % 3 else c, number, role, text, "f", 1))
    rows += [(9000, 1, "user", "Hi.", "f", 1)] * 3 + [(None, 1, "user", "Hi.", "f", 1), (None, None, None, None, None, None), (9001, 5, "system", "x" * 5000, "f", 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir(spark, rows, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{place}/documents.parquet")
    labels = [(r[0], 1, int("idiot" in (r[1] or "") or "scum" in (r[1] or ""))) for r in rows[:150]] + [(None, 1, 1), (3, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(make_turns(), TURNS).repartition(3).write.parquet(f"{place}/conversations.parquet")
    return place


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([], TURNS).write.parquet(f"{place}/conversations.parquet")
    return place
