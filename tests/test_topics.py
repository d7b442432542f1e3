import random
from collections import Counter

from pyspark.sql import functions as F

from palaver.operators import topics

PLANTED = {
    "boats": "anchor harbour rudder sail mast".split(),
    "bread": "dough flour oven yeast crust".split(),
    "garden": "seed spade soil hedge compost".split(),
}


def planted(message_table):
    """Forty messages of one list each, whose words stand in no fixed order, and words that all share."""
    draw, rows = random.Random(5), []
    for i in range(120):
        kind = list(PLANTED)[i % 3]
        words = [draw.choice(PLANTED[kind]) for _ in range(12)]
        rows.append({"timestamp": str(i), "text": " ".join(["the", *words, "and"]), "channel": kind})
    return message_table(*rows, {"timestamp": "e", "text": ""}, {"timestamp": "n", "text": None})


def test_planted_topics_are_found(message_table):
    messages = planted(message_table)
    found = topics.topics(messages, share=0.5).collect()
    groups = {}
    for row in found:
        groups.setdefault(row.topic, set()).add(row.term)
        assert row.topic in groups[row.topic] or any(r.term == row.topic for r in found)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, PLANTED.values()))
    assert all(r.size == 5 for r in found)
    assert sorted(found) == sorted(topics.topics(messages.repartition(7), share=0.5).collect())


def test_messages_get_their_topic(message_table):
    messages = planted(message_table)
    found = topics.topics(messages, share=0.5)
    name = {r.term: r.topic for r in found.collect()}
    rows = topics.message_topics(messages, found).collect()
    assert len(rows) == 120
    assert all(r.topic == name[PLANTED[r.channel][0]] and r.hits == 12 for r in rows)


def test_counts_against_brute_force(message_table):
    texts = ["a bb cc bb", "bb", "cc dd cc ee bb", "", "dd dd"]
    messages = message_table(*[{"timestamp": str(i), "text": t} for i, t in enumerate(texts)])
    got = {r.term: (r.tf, r.df) for r in topics.vocabulary(messages, least=1, share=1.0).collect()}
    lists = [[w for w in t.split() if len(w) > 1] for t in texts]
    every = Counter(w for words in lists for w in words)
    assert got == {w: (n, sum(w in words for words in lists)) for w, n in every.items()}
    near = Counter()
    for words in map(str.split, texts):
        for i, x in enumerate(words):
            near.update(tuple(sorted((x, y))) for y in words[i + 1 : i + 3] if x != y)
    assert {(r.a, r.b): r.n for r in topics.neighbours(messages, reach=2).collect()} == near


def test_ties_and_nothing(spark, message_table):
    ring = spark.createDataFrame([("a", "b", 5), ("b", "c", 5), ("a", "c", 5)], "a string, b string, weight bigint")
    assert {r.topic for r in topics.spread(ring).collect()} == {"a"}
    assert topics.topics(message_table({"text": None})).count() == 0
    best = topics.leading(topics.topics(planted(message_table), share=0.5), k=2)
    assert [r["count"] for r in best.groupBy("topic").count().collect()] == [2, 2, 2]
    assert best.filter((F.col("rank") == 1) & (F.col("term") != F.col("topic"))).isEmpty()


def test_words_and_pairs_are_counted_before_the_exchange(spark):
    """Copies of one text cost the exchange a batch's different words and pairs, not every word."""
    from palaver.operators import topics

    messages = spark.createDataFrame([("c", str(i), "one two two three") for i in range(500)], "channel string, timestamp string, text string").coalesce(1)
    plans = {}
    for name, df in (("terms", topics.vocabulary(messages, share=1.0)), ("pairs", topics.neighbours(messages))):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
    assert all("MapInArrow" in p and "Generate" not in p for p in plans.values())
    assert {(r.term, r.tf, r.df) for r in topics.vocabulary(messages, share=1.0).collect()} == {("one", 500, 500), ("two", 1000, 500), ("three", 500, 500)}
    pairs = {(r.a, r.b): r.n for r in topics.neighbours(messages).collect()}
    assert pairs == {("one", "two"): 1000, ("one", "three"): 500, ("three", "two"): 1000}


def test_pairs_are_exchanged_as_numbers(spark, message_table, monkeypatch):
    """With and without a vocabulary that fits every task: the same topics, and no word in the exchange of pairs where it does."""
    messages = planted(message_table)
    messages = messages.unionByName(messages.limit(5).withColumn("text", F.concat("text", F.lit(" é ßß zz")))).repartition(3)
    words = topics._numbers(topics.vocabulary(messages, share=0.5))
    named = topics.graph(topics.neighbours(messages), topics.vocabulary(messages, share=0.5))
    pairs = topics._known_neighbours(messages, topics.REACH, words)
    assert dict(pairs.dtypes) == {"a": "bigint", "b": "bigint", "n": "bigint"}
    ends = {(words[r.a].as_py(), words[r.b].as_py()) for r in pairs.collect()}
    assert {(r.a, r.b) for r in named.collect()} <= ends and all(a < b for a, b in ends)
    results = []
    for sent in (topics.SENT, 3):
        monkeypatch.setattr(topics, "SENT", sent)
        found = topics.topics(messages, share=0.5)
        results.append((sorted(found.collect()), sorted(topics.message_topics(messages, found).collect())))
    assert results[0] == results[1] and results[0][0]


def test_a_word_of_two_topics_counts_for_both(spark, message_table):
    found = spark.createDataFrame([("aa", "x"), ("aa", "y"), ("bb", "y")], "term string, topic string")
    messages = message_table({"timestamp": "1", "text": "aa bb cc"}, {"timestamp": "2", "text": "bb"}, {"timestamp": "2", "text": "aa aa"}, {"timestamp": "3", "text": "cc"})
    assert sorted(topics.message_topics(messages, found).collect()) == [("general", "1", "y", 2), ("general", "2", "y", 3)]
    assert sorted(topics.message_topics(messages, found.filter("topic = 'y' OR term = 'bb'")).collect()) == [("general", "1", "y", 2), ("general", "2", "y", 3)]


def test_words_are_cut_out_once(spark, message_table):
    messages = planted(message_table)
    words = topics.cut(messages)
    assert words.columns == ["channel", "timestamp", "words"] and words.count() == messages.count()
    found = topics.topics(words, share=0.5)
    assert "regexp_extract_all" not in topics.message_topics(words, found)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(found.collect()) == sorted(topics.topics(messages, share=0.5).collect())
    assert sorted(topics.message_topics(words, found).collect()) == sorted(topics.message_topics(messages, found).collect())
