"""Types of the canonical records, shared by parsers, merge and matching."""

from __future__ import annotations

SEVERITY = "struct<type:string,score:double,vector:string,rating:string,provider:string,source:string>"
REFERENCE = "struct<url:string,name:string,tags:array<string>,source:string>"
RANGE = "struct<introduced:string,fixed:string,last_affected:string,type:string,cpe:string,introduced_exclusive:boolean>"
AFFECTED = f"struct<vendor:string,product:string,ecosystem:string,purl:string,cpes:array<string>,versions:array<string>,ranges:array<{RANGE}>,default_state:string,status:string,source:string>"
SSVC = "struct<exploitation:string,automatable:string,technical_impact:string,source:string>"
#: A canonical record as parsers give it; times are still the texts of the document.
PARSED = (
    "id string, title string, description string, state string, published_text string, modified_text string, withdrawn_text string, assigner string, "
    f"aliases array<string>, related array<string>, cwes array<string>, tags array<string>, severities array<{SEVERITY}>, references array<{REFERENCE}>, "
    f"affected array<{AFFECTED}>, ssvc {SSVC}, source string, record_id string"
)
COMPONENT = "name string, version string, vendor string, ecosystem string, purl string, cpe string, origin string"
SCHEMA_VERSION = 1
