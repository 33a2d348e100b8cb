import re

from segscope.llm.decontaminate import contaminated, without_contaminated

ITEM = "Yesterday the farmer Alice sold 12 kg of apples to Bob while Alice kept 30 pears for the winter market in town."


def test_templates_and_slots(spark):
    docs = {
        1: "Some words. " + ITEM + " More words follow here.",
        2: "intro " + ITEM.replace("Alice", "Maria").replace("Bob", "Jonas").replace("12", "7").replace("30", "99").upper().lower(),
        3: "intro text " + ITEM.replace("Alice", "Maria").replace("Bob", "Jonas").replace("12", "7").replace("30", "99"),
        4: "intro text " + ITEM.replace("Alice", "Maria", 1).replace("Bob", "Jonas"),  # one name stands for two
        5: "intro text " + ITEM.replace("kg", "tons"),
        6: "the farmer sold apples and kept pears for the winter market in town, as ever",
        7: None, 8: "", 9: "short", 10: re.sub(r"[.,]", "", ITEM) + " " + ITEM, 11: "x " * 3000 + ITEM.lower().replace("alice", "Alice").replace("bob", "Bob"),
    }
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs.items()] + [(None, ITEM, 1, ""), (1, "other text", 1, "")],
                               "doc_id long, text string, item_id int, t string")
    bench = spark.createDataFrame([(100, ITEM, 0), (101, "too short here", 0), (102, None, 0), (103, "", 0), (104, "Exactly six words are in here", 0),
                                   (None, ITEM, 0)], "item_id long, text string, pos int")
    rows = contaminated(df, bench).collect()
    kinds = {(r["doc_id"], r["item_id"]): r["kind"] for r in rows}
    assert kinds == {(1, 100): "exact", (3, 100): "reparameterised", (5, 100): "reparameterised", (10, 100): "exact", (11, 100): "exact"}
    kept = without_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 4, 6, 7, 8, 9]
    assert contaminated(df.limit(0), bench).collect() == [] and contaminated(df, bench.limit(0)).collect() == []


def test_short_items_match_whole(spark):
    df = spark.createDataFrame([(1, "we said that exactly six words are in here today"), (2, "exactly six words")], "doc_id long, text string")
    bench = spark.createDataFrame([(104, "exactly six words are in here")], "item_id long, text string")
    assert [(r["doc_id"], r["n_tokens"]) for r in contaminated(df, bench).collect()] == [(1, 6)]


def test_equals_brute_force_on_the_tables(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = {}
    for r in bench.collect():
        w = tokens(r["text"])
        for i in range(len(w) - 12):
            grams.setdefault(tuple(w[i:i + 13]), set()).add(r["item_id"])
    want = {(r["doc_id"], i) for r in docs.collect() for w in [tokens(r["text"])] for k in range(len(w) - 12)
            for i in grams.get(tuple(w[k:k + 13]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    assert want and got >= want and {d for d, _ in got} == {d for d, _ in want}


def test_verbatim_copies_without_literal_windows(spark):
    items = ["What is 12 + 45 * 3 - 7 / 2 + 19 * 4 ?", "Who wrote Hamlet in 1600?", "What is the boiling point of pure water at sea level?",
             "Were Anna Bert Carl Dora Emil Fritz Gerda Hans all there too?", "What is 2+2?", "Alice Bob Carol went home"]
    docs = [(i, "as we noted before, " + t + " and so on") for i, t in enumerate(items)] + [(90, "who wrote it in 1600?"), (91, "What is 12 + 45 * 3 ?")]
    bench = spark.createDataFrame(list(enumerate(items)) + [(99, "?!")], "item_id long, text string")
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["kind"]) for r in rows) == [(i, i, "exact") for i in range(len(items))]


def test_new_values_of_other_lengths(spark):
    tom = ("Tom buys 3 red apples for the school fair in May. Tom then gives 4 of them to a good friend. "
           "Tom eats one more and asks how many he has left.")
    pay = "she paid 3 dollars for the bread and 40 for the long coat and 15 for a pair of old shoes at the market near the station"
    trip = "every summer Anna flies to Paris with her sister and then takes the train to Rome where they meet the rest of the family"
    slip = "the old clock in the hall of the house struck twelve as the red cat slept by the warm fire"
    bench = spark.createDataFrame([(0, tom), (1, pay), (2, trip), (3, slip)], "item_id long, text string")
    docs = [(10, "Some text. " + tom.replace("Tom", "Mia").replace("3", "1,250")), (11, "so " + pay.replace("3", "2.50").replace("40", "1,200").replace("15", "7 1/4")),
            (12, "so " + trip.replace("Anna", "Mary Ann").replace("Paris", "New York").replace("Rome", "San Marino")),
            (13, "so " + slip.replace("house", "very big house")),
            (21, "so the old clock in the hall of the tower and " + "x " * 40 + "red cat slept by the warm fire")]
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["kind"] for r in rows if r["doc_id"] < 20} == {(i + 10, i): "reparameterised" for i in range(4)}
    assert not [r for r in rows if r["doc_id"] == 21]


def test_long_text_of_one_repeated_line(spark):
    """A line that the benchmark holds, over and over: found, in time and memory that grow with the text."""
    import time
    item = "word " * 59 + "word"
    bench = spark.createDataFrame([(1, item), (2, "the old clock in the hall of the house struck twelve as the red cat slept")], "item_id long, text string")
    docs = [(1, "word " * 20_000), (2, "the old clock in the hall of the house struck twelve as the red cat slept\n" * 1500), (3, "word " * 59)]
    started = time.time()
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    found = {(r["doc_id"], r["item_id"]): (r["doc_start"], r["n_tokens"]) for r in rows}
    assert set(found) == {(1, 1), (2, 2), (3, 1)} and found[1, 1][0] == 0 and found[3, 1] == (0, 59) and len(rows) < 2000
    assert time.time() - started < 300


def test_ids_that_are_too_many_to_send(spark, monkeypatch):
    from segscope.llm import decontaminate
    docs = spark.createDataFrame([(i, "so " + ITEM if i % 2 else f"nothing here {i}") for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_IDS", 3)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 3)
    assert sorted(r["doc_id"] for r in without_contaminated(docs, bench).collect()) == list(range(0, 20, 2))
