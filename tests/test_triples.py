"""Turtle, N-Triples, the store with its versions, dictionaries, statistics and streaming."""

import pytest

from graphloom import Engine, TripleStore, scratch
from graphloom.operators import statistics
from graphloom.sources import dictionary, turtle
from graphloom.streaming.ingest import ingest

DOC = r'''@base <http://e/> . @prefix : <http://e/#> . PREFIX x: <http://x/>
# a comment
<a> a :T ; :p "q\"\né" , """long "quoted"
text""" , 'single'@de , 1 , -2.5 , 1e3 , true ;
  x:list ( 1 <b> ) ; x:none () ; x:b [ :p [ ] ; :q _:z ] ; .
_:z :r "d"^^<http://www.w3.org/2001/XMLSchema#dateTime> , "c"^^x:dt .
[ :p <../up> ] :q <http://full/iri> . [ :only 1 ] .
x:a.b x:c x:d .
'''


def triples(df):
    return sorted(map(tuple, df.select("s", "p", "o_v", "o_t", "o_st").collect()), key=repr)


def test_turtle_parser():
    rows = turtle.parse_turtle(DOC)
    assert len(rows) == 23
    assert ("http://e/a", "http://e/#p", 'q"\né', 1, None) in rows and ("http://e/a", "http://e/#p", 'long "quoted"\ntext', 1, None) in rows
    assert ("http://e/a", "http://e/#p", "single", 2, "de") in rows and ("http://e/a", "http://e/#p", "-2.5", 6, None) in rows and ("http://e/a", "http://e/#p", "1e3", 7, None) in rows
    assert ("_:z", "http://e/#r", "d", 9, None) in rows and ("_:z", "http://e/#r", "c", 3, "http://x/dt") in rows
    assert ("http://e/a", "http://x/none", "http://www.w3.org/1999/02/22-rdf-syntax-ns#nil", 0, None) in rows
    assert any(r[1:3] == ("http://e/#p", "http://e/../up") or r[1:3] == ("http://e/#p", "http://e/up") for r in rows)
    assert ("http://x/a.b", "http://x/c", "http://x/d", 0, None) in rows
    for bad in ("<a> <b> .", "<a> <b> <c>", "a:b <c> <d> .", '<a> <b> "x', "<a> _:p <c> .", "<a> <b> ( 1 .", "@prefix x <y> ."):
        with pytest.raises(turtle.TurtleError):
            turtle.parse_turtle(bad)


def test_turtle_files_recover(spark, tmp_path):
    (tmp_path / "one.ttl").write_text("<a> <b> <c> .\nthis is ! no turtle\n<d> <e> _:x .\n<f> <g>\n<h> <i> 5 .\n")
    (tmp_path / "two.ttl").write_text("<a> <b> <c> . _:x <e> 'y' .")
    df = turtle.read_turtle(spark, str(tmp_path)).distinct()
    found = triples(df)
    assert ("a", "b", "c", 0, None) in found and len(found) == 3
    labels = {r[0] for r in found if r[0].startswith("_:")} | {r[2] for r in found if r[2].startswith("_:")}
    assert len(labels) == 2  # a label means another node in another file


def test_ntriples_round_trip(spark, tmp_path):
    want = spark.createDataFrame(
        [
            ("a", "p", "plain", 1, None), ("a", "p", 'q"\\\n\t\r', 1, None), ("a", "p", "\\n", 1, None), ("_:b1", "p", "_:b2", 0, None), ("a", "p", "hi", 2, "en-GB"), ("a", "p", "v", 3, "my"),
            ("a", "p", "5", 5, None), ("a", "p", "s", 4, None), ("a", "p", "", 1, None), ("a", "p", "é\U0001f600", 1, None),
        ],
        turtle.SCHEMA,
    )
    turtle.write_ntriples(want, str(tmp_path / "nt"))
    assert triples(turtle.read_ntriples(spark, str(tmp_path / "nt"))) == triples(want)
    turtle.write_turtle(want, str(tmp_path / "ttl"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "ttl").glob("*.txt")))
    assert sorted(map(tuple, turtle.parse_turtle(text)), key=repr) == triples(want)
    lines = spark.createDataFrame([(r'<a> <p> "é\U0001F600 \\u0041" . # end',), ("no triple",), ("# only a comment",), ("",), ("<a> <p> <x> .",)], "value string")
    assert triples(turtle.ntriples_lines(lines)) == [("a", "p", "x", 0, None), ("a", "p", "é\U0001f600 \\u0041", 1, None)]


def test_store_versions(spark, tmp_path):
    start = turtle.turtle_frame(spark, '<a> <p> 1 , 2 . <a> <p> 1 . <b> <q> "x"@en , "x"@de , "x" .')
    store = TripleStore.create(spark, str(tmp_path / "store"), start)
    e = Engine(store)
    base = triples(store.current())
    assert len(base) == 5
    e.execute('insert data { <c> <p> 3 . <a> <p> 1 }')
    e.execute('delete data { <b> <q> "x"@en }')
    assert len(triples(store.current())) == 5 and len(triples(TripleStore(spark, store.path).current())) == 5
    assert triples(TripleStore(spark, store.path).current()) == base  # nothing is committed yet
    e.execute("rollback")
    assert triples(store.current()) == base
    e.execute('insert data { <c> <p> 3 }')
    e.execute('delete data { <c> <p> 3 }')  # in order: the delete is last
    assert triples(store.current()) == base
    e.execute('insert data { <c> <p> 3 }')
    e.execute("commit")
    e.delete_data('<b> <q> "x"@en .')
    assert store.commit() == 2 and store.commit() == 2
    now = triples(TripleStore(spark, store.path).current())
    assert ("c", "p", "3", 5, None) in now and ("b", "q", "x", 2, "en") not in now and ("b", "q", "x", 2, "de") in now and len(now) == 5
    assert store.sync() == 2 and triples(store.current()) == now and triples(store.as_of(0)) == base and len(triples(store.as_of(1))) == 6
    e.insert_data("<d> <p> 4 .")
    assert store.sync() == 3 and len(triples(TripleStore(spark, store.path).current())) == 6
    assert e.query("select ?s where { ?s <p> 4 }").collect()[0][0] == "d"


def test_dictionary_and_exports(spark, tmp_path):
    df = turtle.turtle_frame(spark, DOC).distinct()
    for by_use in (False, True):
        d = dictionary.build_dictionary(df, by_use).cache()
        ids = sorted(r["id"] for r in d.collect())
        assert ids == list(range(len(ids)))
        predicates = {r["p"] for r in df.select("p").distinct().collect()}
        assert {r["v"] for r in d.where(f"id < {len(predicates)}").collect()} == predicates
        assert triples(dictionary.decode(dictionary.encode(df, d), d)) == triples(df)
    ids = dictionary.encode(df, d)
    dictionary.write_raw(ids, d, str(tmp_path / "raw"))
    assert triples(dictionary.decode(*dictionary.read_raw(spark, str(tmp_path / "raw")))) == triples(df)
    assert "create table facts" in dictionary.write_relational(ids, d, str(tmp_path / "rel"))
    assert spark.read.csv(str(tmp_path / "rel/facts"), header=True).count() == df.count()
    dictionary.write_vertical(ids, str(tmp_path / "vert"), 3)
    assert spark.read.parquet(str(tmp_path / "vert")).count() == df.count()
    assert dictionary.lookup_ids(d, [0]).count() == 1 and dictionary.lookup_terms(d, ["http://e/a"]).count() == 1
    for order in dictionary.ORDERS:
        assert dictionary.permutation(df, order).count() == df.count()


def test_statistics(spark):
    df = turtle.turtle_frame(spark, "<a> <p> <b> , <c> ; <q> 1 . <b> <p> <c> ; <q> 2 . <c> <q> 1 .")
    counts = {k: {tuple(r)[:-1]: r["count"] for r in v.collect()} for k, v in statistics.all_pattern_counts(df).items()}
    assert counts["p"] == {("p",): 3, ("q",): 3} and counts["s"][("a",)] == 3 and counts["po"][("q", "1", 5, None)] == 2
    p, q = df.where("p = 'p'"), df.where("p = 'q'")
    assert statistics.join_partners(p, "o", q, "s") == 3 and statistics.join_partners(p, "s", p, "s") == 5
    assert statistics.join_selectivity(p, "o", q, "s") == pytest.approx(1 / 3) and statistics.join_selectivity(p.limit(0), "o", q, "s") == 0
    sets = {tuple(r["predicates"]): (r["subjects"], r["triples"]) for r in statistics.characteristic_sets(df).collect()}
    assert sets == {("p", "q"): (2, 5), ("q",): (1, 1)}
    assert statistics.star_cardinality(df, ["q"]) == 3 and statistics.star_cardinality(df, ["p", "q"]) == 2
    assert statistics.star_cardinality(df, []) == 3 and statistics.star_cardinality(df, ["p", "none"]) == 0
    many = [f"p{i}" for i in range(130)]
    wide = turtle.turtle_frame(spark, "".join(f"<{x}> <{p}> 1 , 2 . " for x in "ab" for p in many if x == "a" or p != "p99"))
    assert statistics.star_cardinality(wide, many) == 1 and statistics.star_cardinality(wide, many[:99]) == 2


def test_statistics_take_bounded_tasks(spark):
    """A subject's predicates are gathered in a fixed number of partitions, stars by one shuffle of subjects alone."""
    df = turtle.turtle_frame(spark, "<a> <p> <b> .")
    plan = statistics.characteristic_sets(df)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 2  # by subject, by set
    plan = statistics.star_counts(df, ["p", "q"])._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan


def test_streaming_ingest(spark, tmp_path):
    store = TripleStore.create(spark, str(tmp_path / "store"), turtle.turtle_frame(spark, "<a> <p> 1 ."))
    (tmp_path / "in").mkdir()
    for turn, lines in enumerate(["<b> <p> \"x\" .\nnonsense\n", "<b> <p> \"x\" .\n<c> <p> \"y\" .\n"]):
        (tmp_path / "in" / f"{turn}.nt").write_text(lines)
        ingest(spark.readStream.text(str(tmp_path / "in")), store, str(tmp_path / "check"), availableNow=True).awaitTermination()
    assert [r[0] for r in triples(TripleStore(spark, store.path).current())] == ["a", "b", "c"]
    assert len(triples(store.as_of(1))) == 2


def test_sets_are_made_distinct_once(spark, small):
    """Tables without repeated subjects need no distinct at all, pairs of line items one on their keys."""
    from graphloom import queries

    plan = queries.materialised_variable_predicate(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2, plan
    plan = queries.ntriples_round_trip(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1, plan


def test_base_is_written_in_bounded_tasks(spark, tmp_path):
    """What a task of a bulk load sorts is bounded by a setting for the write alone."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1g")
    try:
        seen = []
        rows = spark.range(1000).selectExpr("concat('s', id) s", "'p' p", "'x' o_v", "cast(1 as tinyint) o_t", "cast(null as string) o_st")
        with scratch.bounded_tasks(spark):
            seen.append(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
            with scratch.bounded_tasks(spark):
                pass
            seen.append(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
        assert seen == [str(scratch.TASK_BYTES)] * 2
        assert TripleStore.create(spark, str(tmp_path / "store"), rows, unique=True).current().count() == 1000
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "1g"
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
        with scratch.bounded_tasks(spark):
            assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "1m"
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_dictionary_joins_sort_no_triples(spark, small):
    """The dictionary is the hashed side of every join with it, predicates are sent to the triples, and only the triples that are encoded are made distinct."""
    from graphloom import queries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.dictionary_round_trip(spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 4, plan
    own = queries._geography(spark, small, repeats=True)
    assert "Aggregate [" not in own._jdf.queryExecution().optimizedPlan().toString()
    assert triples(own.distinct()) == triples(queries._geography(spark, small)) and own.count() > own.distinct().count()


def test_dictionary_knows_its_predicates(spark, monkeypatch):
    """A predicate may be a subject, an object or the text of a literal too; triples that repeat make no other dictionary."""
    df = turtle.turtle_frame(spark, '<p> <p> <q> , "p" , "p"@en . <a> <q> <p> , 1 . <b> <r> <a> .').distinct()
    d = dictionary.build_dictionary(df.unionAll(df))
    assert sorted(map(tuple, d.collect()), key=repr) == sorted(map(tuple, dictionary.build_dictionary(df).collect()), key=repr)
    for few in (dictionary.FEW, 0):
        monkeypatch.setattr(dictionary, "FEW", few)
        known = dictionary.predicates(d)
        assert {r["v"] for r in known.collect()} == {"p", "q", "r"}
        assert triples(dictionary.decode(dictionary.encode(df, d, known), d, known)) == triples(df)
