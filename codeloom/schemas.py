"""Fact tables and dimensions. Spans are half-open byte ranges; confidence is ordered strongest first."""

from __future__ import annotations

#: Languages and their file extensions.
LANGUAGES = {
    "bash": "sh bash", "css": "css", "go": "go", "hcl": "tf tfvars hcl", "helm": "tpl", "html": "html htm", "java": "java", "markdown": "md markdown",
    "python": "py pyi", "rust": "rs", "scss": "scss", "tsx": "tsx jsx", "typescript": "ts js mts cts mjs cjs", "xml": "xml", "yaml": "yaml yml", "zig": "zig",
}
IMPERATIVE = ["bash", "go", "java", "python", "rust", "tsx", "typescript", "zig"]
EXTENSIONS = {e: lang for lang, names in LANGUAGES.items() for e in names.split()}
CALLABLE = ["function", "method"]
LOCAL = ["variable", "parameter"]
STRING_KEYED = ["selector", "element-id", "property", "heading", "link-def", "anchor", "data-attribute"]
MULTI_DEFINITION = ["selector", "property", "element-id", "data-attribute"]
TYPES = ["class", "struct", "trait", "interface", "enum", "type"]
MEMBERS = ["method", "field", "property"]
MAX_BYTES = 4 * 1024 * 1024

SYMBOL = "struct<name:string,kind:string,name_start:bigint,name_end:bigint,full_start:bigint,full_end:bigint,scope_id:int,container:bigint,qualifier:string,exported:boolean>"
REF = "struct<name:string,kind:string,start:bigint,end:bigint,scope_id:int,expects:string,receiver:string,receiver_is_path:boolean,in_import:boolean,enclosing:bigint>"
SCOPE = "struct<scope_id:int,start:bigint,end:bigint,parent_id:int>"
IMPORT = "struct<import_pos:int,module:string,alias:string,is_glob:boolean,start:bigint,end:bigint,names:array<struct<original:string,local:string,start:bigint,end:bigint>>>"
TEXT_SPAN = "struct<start:bigint,end:bigint,text:string>"
SUPERTYPE = "struct<type:string,parent:string>"
SUBTREE = "struct<hash:string,tokens:int,depth:int,start:bigint,end:bigint>"
NOTE = "struct<owner:bigint,name:string,arg:string>"
FLOW = "struct<target:bigint,source_start:bigint,source_end:bigint>"
FACTS = (
    "path string, language string, content_sha256 string, symbols array<%s>, refs array<%s>, scopes array<%s>, imports array<%s>, text_spans array<%s>, supertypes array<%s>, subtrees array<%s>, notes array<%s>, flows array<%s>, errors array<bigint>, gaps array<string>"
    % (SYMBOL, REF, SCOPE, IMPORT, TEXT_SPAN, SUPERTYPE, SUBTREE, NOTE, FLOW)
)
