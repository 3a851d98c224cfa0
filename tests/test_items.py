"""Generated items against a plain Python writing of them."""

import hashlib

from pyspark.sql import functions as F

from cairnwork.functions import values as V
from cairnwork.sources import readers

WORDS = ["banana", "été", "x", "new york", ""]


def draw(seed, k, n):
    return int(hashlib.sha1(f"{seed}:{k}".encode()).hexdigest()[:15], 16) % n


def item(i, seed):
    word = WORDS[draw(seed, 0, len(WORDS))]
    at = draw(seed, 2, max(1, len(word)))
    letter = word[at : at + 1] if draw(seed, 1, 10) < 9 else "abcdefghijklmnopqrstuvwxyz"[draw(seed, 3, 26)]
    asked = V.COUNT_QUESTIONS[draw(seed, 4, len(V.COUNT_QUESTIONS))]
    asked = asked.lower() if draw(seed, 5, 10) < 3 else asked
    q, w = (V.QUOTES[draw(seed, k, 3)] for k in (6, 7))
    question = asked.replace("{letter}", q + letter + q).replace("{word}", w + word + w) + ("?" if draw(seed, 8, 2) == 0 else "")
    seen, lines = 0, ""
    for n, c in enumerate(word, 1):
        seen += c == letter
        lines += f"{n}:{c} hit! count={seen}\n" if c == letter else f"{n}:{c}\n"
    head = f"We are asked to find the number '{letter}' in the word '{word}'. Let me try a manual approach first.\n\nFirst spell the word out:\n{word}:{','.join(word)}\n\nThen count the occurrences of '{letter}':\n"
    return (i, word, letter, question, f"{head}{lines}\nThis gives us {seen}.", f"'{word}'.count('{letter}')", seen, f"\n\nPython gives us {seen}.\n\nMy final answer is:\n\n#### {seen}")


def words(spark):
    return spark.createDataFrame(list(enumerate(WORDS)), "idx long, word string")


def test_items(spark):
    for test in (False, True):
        got = [tuple(r) for r in readers.spelling(spark, words(spark), 300, test).orderBy("idx").collect()]
        assert got == [item(i, i + test * readers.TEST_SEEDS) for i in range(300)]


def test_spelled(spark):
    got = readers.spelled_words(spark, words(spark), 40).where("answer = 'banana:b,a,n,a,n,a'")
    assert {r["question"] for r in got.collect()} == {"Spell the word: banana"}
    assert readers.spelled_words(spark, words(spark).where(F.lit(False)), 5).count() == 0
