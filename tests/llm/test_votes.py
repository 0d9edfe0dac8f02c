"""The labelers' votes decide which loose candidates of personal data become spans."""

import random

from octaspark.llm import pii


def test_votes_separate_candidates(spark):
    rnd = random.Random(4)
    rows, secrets = [], set()
    for i in range(300):
        if i % 3:  # a key word in prose: short words behind a colon
            s = f"{rnd.choice(['token', 'secret', 'password'])}: {rnd.choice(['aaaa', 'none', 'none.', 'hhhhhh'])}"
        else:
            s = f'password = "{"".join(rnd.choice("abcdefgh0123456789") for _ in range(16))}'
            secrets.add(i)
        rows.append((i, f"some words before {s} and behind"))
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r.n_added_secret} == secrets
    one = got[0]
    at = rows[0][1].index("password")
    assert one.spans == f"secret:{at}:{at + len('password = ') + 17}"


def test_kinds_are_estimated_apart():
    # telephone numbers: the border labeler is right; secrets: it is noise, and shape is right
    counts = [("phone", False, (1, 2, 2, 1, 1), 90.0), ("phone", False, (1, 2, 2, 0, 1), 5.0), ("phone", True, (1, 1, 1, 1, 1), 100.0)]
    counts += [("secret", False, (1, 1, 2, 0, 1), 60.0), ("secret", False, (0, 1, 2, 0, 2), 60.0), ("secret", False, (0, 1, 2, 1, 2), 60.0)]
    w = pii.learn(counts)

    def accept(kind, votes):
        return sum(a * b for a, b in zip(w, pii._features(kind, votes))) >= 0

    assert accept("phone", (1, 2, 2, 1, 1)) and accept("secret", (1, 1, 2, 0, 1)) and not accept("secret", (0, 1, 2, 0, 2)) and not accept("secret", (0, 1, 2, 1, 2))


def test_candidates_that_overlap_base_spans_are_not_added(spark):
    df = spark.createDataFrame([(1, "call +1 (415) 555-1234 or 415-555-9999 now")], "doc_id long, text string")
    got = pii.report(df).first()
    assert got.n_phone == 1 and got.spans.split(",")[0] == "phone:5:22" and len(got.spans.split(",")) <= 2
