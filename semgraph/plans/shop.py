"""The sample domain: a shop's customers, orders, parts, suppliers and events as a graph."""

from __future__ import annotations

from semgraph.plans.mapping import Attribute, ClassMap, Mapping, Relation
from semgraph.plans.ontology import DataProperty, ObjectProperty, Ontology, OntologyClass
from semgraph.functions.terms import XSD

EX = "http://shop.example/ns#"
BASE = "http://shop.example/"

REGION, NATION, PARTY = EX + "Region", EX + "Nation", EX + "Party"
CUSTOMER, SUPPLIER, PART = EX + "Customer", EX + "Supplier", EX + "Part"
ORDER, EVENT, USER = EX + "Order", EX + "Event", EX + "User"


def _attributes(**columns: str) -> tuple[Attribute, ...]:
    return tuple(Attribute(EX + name, column) for name, column in columns.items())


MAPPING = Mapping(
    base_iri=BASE,
    classes=(
        ClassMap(REGION, "region", ("r_regionkey",), _attributes(name="r_name")),
        ClassMap(NATION, "nation", ("n_nationkey",), _attributes(name="n_name")),
        ClassMap(
            CUSTOMER, "customer", ("c_custkey",),
            _attributes(name="c_name", balance="c_acctbal", segment="c_mktsegment"),
        ),
        ClassMap(SUPPLIER, "supplier", ("s_suppkey",), _attributes(name="s_name", balance="s_acctbal")),
        ClassMap(
            PART, "part", ("p_partkey",),
            _attributes(name="p_name", brand="p_brand", partType="p_type", size="p_size", price="p_retailprice"),
        ),
        ClassMap(
            ORDER, "orders", ("o_orderkey",),
            _attributes(status="o_orderstatus", totalPrice="o_totalprice", orderDate="o_orderdate",
                        priority="o_orderpriority"),
        ),
        ClassMap(EVENT, "events", ("event_id",), _attributes(eventType="event_type", at="ts", value="value")),
    ),
    relations=(
        Relation(EX + "inRegion", NATION, REGION, target_key=("n_regionkey",)),
        Relation(EX + "inNation", CUSTOMER, NATION, target_key=("c_nationkey",)),
        Relation(EX + "inNation", SUPPLIER, NATION, target_key=("s_nationkey",)),
        Relation(EX + "placedBy", ORDER, CUSTOMER, target_key=("o_custkey",)),
        Relation(EX + "contains", ORDER, PART, table="lineitem", source_key=("l_orderkey",), target_key=("l_partkey",)),
        Relation(
            EX + "suppliedBy", PART, SUPPLIER, table="lineitem", source_key=("l_partkey",), target_key=("l_suppkey",)
        ),
        Relation(EX + "performedBy", EVENT, CUSTOMER, target_key=("user_id",)),
    ),
)

ONTOLOGY = Ontology(
    classes=(
        OntologyClass(REGION), OntologyClass(NATION), OntologyClass(PARTY),
        OntologyClass(CUSTOMER, parents=(PARTY,)), OntologyClass(SUPPLIER, parents=(PARTY,)),
        OntologyClass(PART), OntologyClass(ORDER), OntologyClass(EVENT),
    ),
    object_properties=(
        ObjectProperty(EX + "inRegion", NATION, REGION, characteristics=("functional",)),
        ObjectProperty(EX + "inNation", None, NATION, domains=(CUSTOMER, SUPPLIER), characteristics=("functional",)),
        ObjectProperty(EX + "placedBy", ORDER, CUSTOMER, characteristics=("functional",)),
        ObjectProperty(EX + "contains", ORDER, PART),
        ObjectProperty(EX + "suppliedBy", PART, SUPPLIER),
        ObjectProperty(EX + "performedBy", EVENT, CUSTOMER),
    ),
    data_properties=(
        DataProperty(EX + "name"),
        DataProperty(EX + "balance", PARTY, XSD + "double"),
        DataProperty(EX + "segment", CUSTOMER, XSD + "string"),
        DataProperty(EX + "brand", PART, XSD + "string"),
        DataProperty(EX + "partType", PART, XSD + "string"),
        DataProperty(EX + "size", PART, XSD + "integer"),
        DataProperty(EX + "price", PART, XSD + "double"),
        DataProperty(EX + "status", ORDER, XSD + "string"),
        DataProperty(EX + "totalPrice", ORDER, XSD + "double"),
        DataProperty(EX + "orderDate", ORDER, XSD + "dateTime"),
        DataProperty(EX + "priority", ORDER, XSD + "string"),
        DataProperty(EX + "eventType", EVENT, XSD + "string"),
        DataProperty(EX + "at", EVENT, XSD + "dateTime"),
        DataProperty(EX + "value", EVENT, XSD + "double"),
    ),
)
