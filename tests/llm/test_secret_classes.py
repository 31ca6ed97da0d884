import random

from retort.llm import secret_scan


def test_one_case_letters_digits_and_path_tails_are_reported(spark):
    rng = random.Random(5)
    pick = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(40))
    letters, digits = pick("abcdefghijklmnopqrstuvwxyz"), pick("0123456789")[:25]  # 32 digits are a hex run
    mixed = pick("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    words = [letters, letters.upper(), digits, f"app/prod/{mixed}"]
    quiet = ["some/path/of/plain/words", "usr/local/share/file-name", "several-plain-words-with-dashes", "counterrevolutionary"]
    d = spark.createDataFrame(list(enumerate(words + quiet)), "doc_id long, text string")
    got = {r.doc_id: [(x.s, x.e) for x in r.extra] for r in secret_scan.scan_secrets(d).collect()}
    assert got == {i: [(0, len(w))] if i < len(words) else [] for i, w in enumerate(words + quiet)}
