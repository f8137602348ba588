"""The tool server by its messages: what it offers, what it refuses, and that nothing ends it."""

import json

import pytest

from packspark import server
from packspark.__main__ import answer


class Engine:
    """Stands for an engine: says what it was asked."""

    def __init__(self, root):
        self.root = root

    def analyze_query(self, query):
        if query == "crash":
            raise RuntimeError("broken index")
        return {"query": query, "root": self.root}

    def get_context_bundle(self, query, max_tokens=None, intent=None):
        return {"query": query, "max_tokens": max_tokens, "intent": intent}

    prepare_context = get_context_bundle

    def context_prompt(self, query=""):
        return f"context of {query or 'everything'}"


class Engines:
    def get(self, root=None):
        return Engine(root)

    def expand_context(self, bundle_id, focus=None, extra_tokens=None):
        return {"bundle_id": bundle_id, "focus": focus, "extra_tokens": extra_tokens} if bundle_id == "b" else {"error": "unknown bundle id"}

    def estimate_tokens(self, text=None, bundle_id=None):
        return {"tokens": len(text or "") // 4}


def ask(method, params=None, number=1):
    return json.loads(server.respond(Engines(), json.dumps({"jsonrpc": "2.0", "id": number, "method": method} | ({"params": params} if params is not None else {}))))


def tool(name, **args):
    got = ask("tools/call", {"name": name, "arguments": args})["result"]
    return got["isError"], got["content"][0]["text"]


def test_what_is_offered():
    hello = ask("initialize", {"protocolVersion": "2024-11-05", "capabilities": {}}, "first")
    assert hello["id"] == "first" and hello["result"]["protocolVersion"] == "2024-11-05" and set(hello["result"]["capabilities"]) == {"tools", "prompts"}
    tools = {t["name"]: t["inputSchema"] for t in ask("tools/list")["result"]["tools"]}
    assert set(tools) == {"prepare_context", "analyze_query", "get_context_bundle", "expand_context", "estimate_tokens"}
    assert tools["expand_context"]["required"] == ["bundle_id"] and tools["get_context_bundle"]["properties"]["max_tokens"]["type"] == "integer"
    assert [p["name"] for p in ask("prompts/list")["result"]["prompts"]] == ["context"] and ask("ping")["result"] == {}


def test_calls():
    assert tool("analyze_query", query="q", workspace_root="/w") == (False, json.dumps({"query": "q", "root": "/w"}))
    assert json.loads(tool("get_context_bundle", query="q", max_tokens=2000, intent=None)[1]) == {"query": "q", "max_tokens": 2000, "intent": None}
    assert json.loads(tool("expand_context", bundle_id="b", extra_tokens=5)[1]) == {"bundle_id": "b", "focus": None, "extra_tokens": 5}
    assert json.loads(tool("estimate_tokens", text="abcdefgh")[1]) == {"tokens": 2}
    assert tool("expand_context", bundle_id="x")[0] and tool("analyze_query", query="crash") == (True, "RuntimeError: broken index")
    message = ask("prompts/get", {"name": "context", "arguments": {"query": "q"}})["result"]["messages"][0]
    assert message["role"] == "user" and message["content"]["text"] == "context of q"


@pytest.mark.parametrize(
    ("params", "code"),
    [
        ({"name": "sing"}, -32602), ({"name": "analyze_query"}, -32602), ({"name": "analyze_query", "arguments": {"query": 7}}, -32602), ({"name": "analyze_query", "arguments": {"query": "q", "x": 1}}, -32602),
        ({"name": "get_context_bundle", "arguments": {"query": "q", "max_tokens": "2000"}}, -32602), ({"name": "get_context_bundle", "arguments": {"query": "q", "max_tokens": True}}, -32602), ({"name": "analyze_query", "arguments": [1]}, -32602), ([], -32601),
    ],
)
def test_what_is_refused(params, code):
    method = "tools/call" if isinstance(params, dict) else "tools/sing"
    assert ask(method, params)["error"]["code"] == code


def test_nothing_ends_the_loop():
    lines = ["{", "", "[]", "7", "null", '{"jsonrpc": "1.0", "id": 1, "method": "ping"}', '{"jsonrpc": "2.0", "method": "notifications/initialized"}', '{"jsonrpc": "2.0", "id": 2, "method": "ping", "params": [1]}', '{"tool": "analyze_query", "args": [1]}', '{"tool": "analyze_query", "args": {"query": "q"}}', '{"jsonrpc": "2.0", "id": 3, "method": "ping"}']
    got = [json.loads(x) for x in server.serve(Engines(), lines)]
    assert [x.get("error", {}).get("code") if isinstance(x.get("error"), dict) else None for x in got] == [-32700, -32600, -32600, -32600, -32600, -32602, None, None, None]
    assert got[-3] == {"error": "arguments must be an object"} and got[-2] == {"query": "q", "root": None} and got[-1]["result"] == {}
    assert answer(Engines(), {"tool": "context_prompt", "args": {}}) == "context of everything"
