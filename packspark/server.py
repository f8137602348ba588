"""The engine as a tool server: JSON-RPC 2.0, one message a line, in the shape of the Model Context
Protocol. ``respond`` maps a line to the answer's line (None for notifications); nothing a client sends
ends the loop. Lines of the short form {"tool": NAME, "args": {...}} are answered with the bare result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from packspark.api import Engines

PROTOCOL = "2024-11-05"
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS = -32700, -32600, -32601, -32602
_QUERY = {"query": ("string", "What the context is for", True), "workspace_root": ("string", "Folder to search; the default one if absent", False)}
_LIMITS = {"max_tokens": ("integer", "Token budget; chosen if absent", False), "intent": ("string", "debug, implement, explain, refactor or review", False)}
#: name -> (what it does, argument -> (type, meaning, required))
TOOLS: dict[str, tuple[str, dict[str, tuple[str, str, bool]]]] = {
    "prepare_context": ("Bundle, analysis and message for a query", _QUERY | _LIMITS),
    "analyze_query": ("Intent, confidence, signals and budget of a query", _QUERY),
    "get_context_bundle": ("A token-budgeted bundle of chunks for a query", _QUERY | _LIMITS),
    "expand_context": ("A larger bundle under the same id", {"bundle_id": ("string", "Which bundle", True), "focus": ("string", "A file to include whole", False), "extra_tokens": ("integer", "How much larger", False)}),
    "estimate_tokens": ("Tokens of a text or of a bundle", {"text": ("string", "The text", False), "bundle_id": ("string", "Which bundle", False)}),
}
PROMPT = {"name": "context", "description": "A message with the context of a query", "arguments": [{"name": "query", "description": "What the context is for", "required": False}]}
_KINDS = {"string": str, "integer": int}


class Refused(Exception):
    """A request that can't be answered: code and message of the error."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def schema(name: str) -> dict:
    about, args = TOOLS[name]
    properties = {k: {"type": t, "description": d} for k, (t, d, _) in args.items()}
    return {"name": name, "description": about, "inputSchema": {"type": "object", "properties": properties, "required": [k for k, a in args.items() if a[2]]}}


def checked(name: object, args: object) -> dict:
    """The arguments of a tool if they are what it takes; nulls count as absent."""
    if name not in TOOLS:
        raise Refused(INVALID_PARAMS, f"unknown tool {name}")
    if not isinstance(args, dict):
        raise Refused(INVALID_PARAMS, "arguments must be an object")
    takes = TOOLS[name][1]
    given = {k: v for k, v in args.items() if v is not None}
    for k, v in given.items():
        if k not in takes:
            raise Refused(INVALID_PARAMS, f"unknown argument {k}")
        if not isinstance(v, _KINDS[takes[k][0]]) or isinstance(v, bool):
            raise Refused(INVALID_PARAMS, f"{k} must be of type {takes[k][0]}")
    if missing := [k for k, a in takes.items() if a[2] and k not in given]:
        raise Refused(INVALID_PARAMS, f"missing {', '.join(missing)}")
    return given


def call(engines: Engines, name: str, args: dict) -> object:
    if name in ("expand_context", "estimate_tokens"):
        return getattr(engines, name)(**args)
    rest = {k: v for k, v in args.items() if k != "workspace_root"}
    return getattr(engines.get(args.get("workspace_root")), name)(**rest)


def result_of(engines: Engines, method: object, params: dict) -> object:
    if method == "initialize":
        return {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}, "prompts": {}}, "serverInfo": {"name": "packspark", "version": "1"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [schema(n) for n in TOOLS]}
    if method == "tools/call":
        args = checked(params.get("name"), params.get("arguments") or {})
        try:
            found = call(engines, params["name"], args)
        except Exception as e:  # what a tool raises is its result, not the server's end
            return {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}
        failed = isinstance(found, dict) and "error" in found
        return {"content": [{"type": "text", "text": json.dumps(found, default=str)}], "isError": failed}
    if method == "prompts/list":
        return {"prompts": [PROMPT]}
    if method == "prompts/get":
        args = params.get("arguments") or {}
        if params.get("name") != "context" or not isinstance(args, dict) or not isinstance(args.get("query", ""), str):
            raise Refused(INVALID_PARAMS, "the only prompt is context, with a query")
        text = engines.get(None).context_prompt(args.get("query", ""))
        return {"messages": [{"role": "user", "content": {"type": "text", "text": text}}]}
    raise Refused(NO_METHOD, f"no method {method}")


def respond(engines: Engines, line: str) -> str | None:
    """The line that answers a line."""
    number = None
    try:
        try:
            request = json.loads(line)
        except ValueError:
            raise Refused(PARSE_ERROR, "not JSON") from None
        if isinstance(request, dict) and "method" not in request and "tool" in request:
            return json.dumps(short(engines, request), default=str)
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
            raise Refused(INVALID_REQUEST, "not a JSON-RPC 2.0 request")
        if "id" not in request:
            return None  # notifications need no answer
        number, params = request["id"], request.get("params") or {}
        if not isinstance(params, dict):
            raise Refused(INVALID_PARAMS, "params must be an object")
        return json.dumps({"jsonrpc": "2.0", "id": number, "result": result_of(engines, request["method"], params)})
    except Refused as e:
        return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": e.code, "message": str(e)}})


def short(engines: Engines, request: dict) -> object:
    """The result of {"tool": …, "args": …}, or {"error": …}."""
    name, args = request.get("tool"), request.get("args") or {}
    if name == "context_prompt" and isinstance(args, dict):
        rest = {k: v for k, v in args.items() if k == "query" and isinstance(v, str)}
        return engines.get(args.get("workspace_root")).context_prompt(**rest)
    try:
        return call(engines, name, checked(name, args))
    except Refused as e:
        return {"error": str(e)}


def serve(engines: Engines, lines: Iterable[str]) -> Iterator[str]:
    for line in lines:
        if line.strip() and (answer := respond(engines, line)) is not None:
            yield answer
