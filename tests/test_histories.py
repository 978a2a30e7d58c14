"""Imports of document histories, datom logs and Cypher scripts."""

import json

import pytest

from strataweave.operators import temporal as TP
from strataweave.sources import edn, histories, script

JAN, FEB, MAR, APR = (edn.micros_of(f"2022-0{m}-01T00:00:00Z") for m in (1, 2, 3, 4))


def test_edn_values():
    assert edn.parse('{:a/b [1 -2.5 "x\\n\\"y" \\newline nil true] #_ gone :c #{:k} ; note\n :t #inst "1970-01-01T00:00:01Z" :u #uuid "f0"}') == [
        {"a/b": [1, -2.5, 'x\n"y', "\n", None, True], "c": ["k"], "t": 1_000_000, "u": "f0"}
    ]
    assert list(edn.elements("[1 [2 3]] 4")) == [1, [2, 3], 4] and list(edn.elements("")) == []
    for bad in ("[1 2", "]", '"open', "{:a}", "#inst", '#inst "noon"', "99999999999999999999", "[" * 200):
        with pytest.raises(edn.EdnError):
            list(edn.elements(bad))


DOCS = """[{:xt/id :pump :history [
   {:xt/valid-time #inst "2022-01-01T00:00:00Z" :xt/tx-time #inst "2022-02-01T00:00:00Z" :xt/tx-id 1
    :xt/doc {:xt/id :pump :type "Machine" :rpm 900 :site :hall}}
   {:xt/valid-time #inst "2022-03-01T00:00:00Z" :xt/tx-time #inst "2022-03-01T00:00:00Z" :xt/tx-id 2
    :xt/doc {:xt/id :pump :type "Machine" :rpm 1200}}
   {:xt/valid-time #inst "2022-04-01T00:00:00Z" :xt/tx-time #inst "2022-04-01T00:00:00Z" :xt/tx-id 3 :xt/doc nil}]}
 {:xt/id :hall :history [{:xt/valid-time #inst "2022-01-01T00:00:00Z" :xt/tx-id 0 :xt/doc {:name "Hall"}
                          :xt/valid-to #inst "2022-03-01T00:00:00Z"}]}]"""


def test_document_history(spark, tmp_path):
    (tmp_path / "d.edn").write_text(DOCS)
    nodes, edges, bad = histories.import_document_history(spark, str(tmp_path / "d.edn"))
    seen = lambda v, t=TP.OPEN: {r["key"]: (r["label"], json.loads(r["properties_json"])) for r in TP.as_of(nodes, v, t).collect()}
    assert seen(JAN) == {"pump": ("Machine", {"rpm": 900}), "hall": ("Entity", {"name": "Hall"})}
    assert seen(MAR) == {"pump": ("Machine", {"rpm": 1200})}  # the hall's valid-to is met by no segment
    assert seen(APR) == {} and seen(JAN, JAN) == {"hall": ("Entity", {"name": "Hall"})}
    assert [r["label"] for r in TP.as_of(edges, FEB).collect()] == ["SITE"] and TP.as_of(edges, MAR).isEmpty()
    assert bad.isEmpty()


def test_document_history_rejects(spark, tmp_path):
    (tmp_path / "d.edn").write_text('[{:xt/id :a :history [{:xt/valid-time #inst "2022-01-01T00:00:00Z" :xt/doc {:boss :nobody}}]} {:history []} 7')
    path = str(tmp_path / "d.edn")
    nodes, edges, bad = histories.import_document_history(spark, path, refs={"boss": "REPORTS_TO"}, on_error="skip")
    reasons = sorted(r["reason"] for r in bad.collect())
    assert len(reasons) == 4 and reasons[:2] == ["7 is no map", "a boss nobody has no target"] and reasons[-1].startswith("unreadable")
    assert [r["properties_json"] for r in nodes.collect()] == ["{}"] and edges.isEmpty()
    with pytest.raises(Exception, match="without id"):
        histories.import_document_history(spark, path)[0].collect()
    (tmp_path / "none.edn").write_text("")
    assert [df.count() for df in histories.import_document_history(spark, str(tmp_path / "none.edn"))] == [0, 0, 0]


DATOMS = """[{:e 1 :a :site/name :v "North" :tx 10 :tx-instant #inst "2022-01-01T00:00:00Z" :op true}
 {:e 2 :a :pump/rpm :v 900 :tx 11 :tx-instant #inst "2022-02-01T00:00:00Z" :op true}
 {:e 2 :a :pump/tag :v "b" :tx 11 :tx-instant #inst "2022-02-01T00:00:00Z" :op true}
 {:e 2 :a :pump/tag :v "a" :tx 11 :tx-instant #inst "2022-02-01T00:00:00Z" :op true}
 {:e 2 :a :pump/site :v 1 :tx 11 :tx-instant #inst "2022-02-01T00:00:00Z" :op true}
 {:e 2 :a :pump/rpm :v 900 :tx 12 :tx-instant #inst "2022-03-01T00:00:00Z" :op false}
 {:e 2 :a :pump/rpm :v 1200 :tx 12 :tx-instant #inst "2022-03-01T00:00:00Z" :op true}
 {:e 2 :a :pump/tag :v "b" :tx 12 :tx-instant #inst "2022-03-01T00:00:00Z" :op false}
 {:e 2 :a :pump/rpm :v 1200 :tx 13 :tx-instant #inst "2022-04-01T00:00:00Z" :op false}
 {:e 2 :a :pump/site :v 1 :tx 13 :tx-instant #inst "2022-04-01T00:00:00Z" :op false}
 {:e 2 :a :pump/site :v 9 :tx 13 :tx-instant #inst "2022-04-01T00:00:00Z" :op true}
 {:e 5 :a :db/ident :v :site/name :tx 10 :tx-instant #inst "2022-01-01T00:00:00Z" :op true}]"""
ATTRIBUTES = """{:site/name {:db/valueType :db.type/string :db/cardinality :db.cardinality/one}
 :pump/tag {:db/valueType :db.type/string :db/cardinality :db.cardinality/many}
 :pump/site {:db/valueType :db.type/ref :db/cardinality :db.cardinality/one :graph/edge-label "STANDS_IN"}}"""


def test_datoms(spark, tmp_path):
    (tmp_path / "log.edn").write_text(DATOMS)
    (tmp_path / "schema.edn").write_text(ATTRIBUTES)
    schema = histories.attribute_schema(spark, str(tmp_path / "schema.edn"))
    nodes, edges, bad = histories.import_datoms(spark, str(tmp_path / "log.edn"), schema, many="list")
    at = lambda df, v: [(r["key"], r["label"], json.loads(r["properties_json"])) for r in TP.as_of(df, v).orderBy("key").collect()]
    north = ("1", "Site", {"name": "North"})
    assert at(nodes, JAN) == [north]
    assert at(nodes, FEB) == [north, ("2", "Pump", {"rpm": 900, "tag": ["a", "b"]})]
    assert at(nodes, MAR) == [north, ("2", "Pump", {"rpm": 1200, "tag": ["a"]})]
    assert at(nodes, APR) == [north, ("2", "Pump", {"tag": ["a"]})]
    assert [r["label"] for r in TP.as_of(edges, MAR).collect()] == ["STANDS_IN"] and TP.as_of(edges, APR).isEmpty()
    assert sorted(r["reason"] for r in bad.collect()) == ["2 pump/site 9 has no target", "unsupported attribute db/ident"]
    last = histories.import_datoms(spark, str(tmp_path / "log.edn"), schema)[0]
    assert [p["tag"] for k, _, p in at(last, FEB) if k == "2"] == ["b"] and [p["tag"] for k, _, p in at(last, MAR) if k == "2"] == ["a"]


SCRIPT = """:begin
CREATE CONSTRAINT ON (node:`UNIQUE IMPORT LABEL`) ASSERT (node.`UNIQUE IMPORT ID`) IS UNIQUE;
:commit
:begin
CREATE (:`Pump`:`UNIQUE IMPORT LABEL` {`name`:"P; 1", `rpm`:900, `made`:date('1970-01-02'), `at`:point({x: 1}), `UNIQUE IMPORT ID`:0});
UNWIND [{_id:1, properties:{name:"Hall", area:2.5}}] AS row
CREATE (n:`UNIQUE IMPORT LABEL`{`UNIQUE IMPORT ID`: row._id}) SET n += row.properties SET n:Site;
:commit
:begin
MATCH (a:`UNIQUE IMPORT LABEL`{`UNIQUE IMPORT ID`:0}), (b:`UNIQUE IMPORT LABEL`{`UNIQUE IMPORT ID`:1}) CREATE (a)-[:`STANDS_IN` {`since`:2020}]->(b);
UNWIND [{start: {_id:1}, end: {_id:0}, properties:{n:1}}, {start: {_id:1}, end: {_id:7}, properties:{}}] AS row
MATCH (start:`UNIQUE IMPORT LABEL`{`UNIQUE IMPORT ID`: row.start._id}) MATCH (end:`UNIQUE IMPORT LABEL`{`UNIQUE IMPORT ID`: row.end._id})
CREATE (start)-[r:`HOLDS`]->(end) SET r += row.properties;
MATCH (a:Pump {rpm: 900}), (b:Site {name: 'Hall'}) CREATE (a)<-[:FEEDS]-(b);
:commit
MERGE (n:Pump {name: "x"});
CREATE (:`Pump` {`name`:"cut"""


def test_script(spark, tmp_path):
    (tmp_path / "dump.cypher").write_text(SCRIPT)
    nodes, edges, bad = script.import_script(spark, str(tmp_path / "dump.cypher"), on_error="skip")
    found = {r["id"]: (r["label"], json.loads(r["properties_json"])) for r in nodes.collect()}
    assert sorted(found.values()) == [("Pump", {"name": "P; 1", "rpm": 900, "made": 86_400_000_000}), ("Site", {"name": "Hall", "area": 2.5})]
    links = sorted((r["label"], found[r["src"]][0], found[r["dst"]][0], r["properties_json"]) for r in edges.collect())
    assert links == [("FEEDS", "Site", "Pump", "{}"), ("HOLDS", "Site", "Pump", '{"n": 1}'), ("STANDS_IN", "Pump", "Site", '{"since": 2020}')]
    reasons = sorted(r["reason"] for r in bad.collect())
    assert len(reasons) == 4 and reasons[0].startswith("'CREATE' expected") and reasons[1] == "HOLDS 1 7 has an end that is not known"
    assert reasons[2] == "dropped at: a value of point()" and reasons[3].startswith("unreadable")
    with pytest.raises(Exception, match="CREATE|unreadable|point"):
        script.import_script(spark, str(tmp_path / "dump.cypher"))[0].collect()
