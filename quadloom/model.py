"""Names and schemas of the data model: records as quads, statements about triples, search rows."""

from __future__ import annotations

#: Public vocabularies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
DCTERMS = "http://purl.org/dc/terms/"
DC = "http://purl.org/dc/elements/1.1/"
FOAF = "http://xmlns.com/foaf/0.1/"
GEO = "http://www.w3.org/2003/01/geo/wgs84_pos#"
#: This library's own vocabulary for labels, descriptions and revision metadata.
VOCAB = "http://example.org/vocab#"

TYPE, THING = f"{RDF}type", f"{OWL}Thing"
SUBJECT, PREDICATE, OBJECT, STATEMENT = f"{RDF}subject", f"{RDF}predicate", f"{RDF}object", f"{RDF}Statement"
LABEL, ALT_LABEL, DESCRIPTION = f"{VOCAB}prefLabel", f"{VOCAB}altLabel", f"{VOCAB}description"
LAT, LONG, ALT = f"{GEO}lat", f"{GEO}long", f"{GEO}alt"
LAT_LONG, POLYGON, POLYLINE, LOCATED_IN = f"{GEO}lat_long", f"{VOCAB}polygonCoordinates", f"{VOCAB}polylineCoordinates", f"{VOCAB}locatedIn"
#: Preferred page of a record.
URL = f"{VOCAB}prefURL"
PART_OF = f"{DCTERMS}isPartOf"
REVISION = f"{VOCAB}Revision"
REVISION_META = (f"{VOCAB}revisionUri", f"{VOCAB}fromDataset", f"{VOCAB}revisionTime", f"{VOCAB}performer", f"{VOCAB}revisionStatus")

#: Ranked label and description properties; every operator that uses them takes another list as a parameter.
LABELS = (LABEL, ALT_LABEL, f"{SKOS}prefLabel", f"{SKOS}altLabel", f"{DCTERMS}title", f"{DC}title", f"{RDFS}label", f"{FOAF}name")
DESCRIPTIONS = (DESCRIPTION, f"{SKOS}definition", f"{DCTERMS}description", f"{DC}description", f"{RDFS}comment")

QUADS = "g string, s string, p string, o string, o_kind string, o_type string, o_lang string, pos long"
STATEMENTS = "g string, stmt string, s string, p string, o string, rei_p string, rei_o string"
ATTRIBUTE = "struct<value:string,uri:string,lang:string,type:string,reify:map<string,array<string>>>"
