"""Names and types of the log shapes' fields."""

from __future__ import annotations

#: Shapes in the order in which they are tried.
SHAPES = ["canonical", "java", "message", "time_only", "json", "logfmt", "text"]

#: For each field its names (the own one first) and its type:
#: ts, str, uint (non-negative integer), strnum (string or number), any.
TIME_NAMES = ["timestamp", "time", "ts"]
CANONICAL = {
    "timestamp": (TIME_NAMES, "ts"),
    "level": (["level"], "str"),
    "message": (["message"], "str"),
    "method": (["method"], "str"),
    "url": (["url"], "str"),
    "status": (["status"], "uint"),
    "elapsed": (["elapsed"], "str"),
    "size": (["size"], "uint"),
    "request_id": (["request_id"], "str"),
    "remote_host": (["remote_host"], "str"),
    "user_agent": (["user_agent"], "str"),
}
JAVA = {
    "timestamp": (TIME_NAMES, "ts"),
    "message": (["message", "msg"], "str"),
    "level": (["level", "severity"], "str"),
    "thread": (["thread", "threadName"], "str"),
    "request_id": (["request_id", "requestid", "requestId"], "str"),
    "class": (["class"], "str"),
    "method": (["method"], "str"),
    "source": (["source"], "str"),
    "stack_trace": (["stackTrace"], "str"),
}
MESSAGE = {
    "timestamp": (["timestamp", "time", "ts", "@timestamp", "time_local"], "ts"),
    "message": (["message", "msg", "body"], "str"),
    "level": (["level", "lvl", "severity"], "str"),
    "method": (["method", "requestMethod"], "str"),
    "url": (["url", "requestUrl"], "str"),
    "status": (["status", "statusCode", "code"], "strnum"),
    "elapsed": (["elapsed", "elapsed_ms", "elapsed_time", "latency"], "str"),
    "size": (["size", "sent_bytes", "length", "written", "bodylen", "responseSize"], "strnum"),
    "request_id": (["request_id", "requestId", "requestid"], "str"),
    "thread": (["thread", "threadName", "thread_name", "thread_id"], "str"),
    "host": (["host", "hostname", "remote_host", "remoteIp", "source_host"], "str"),
    "user_agent": (["user_agent", "userAgent"], "str"),
    "module": (["module", "mod", "lib", "class", "className", "loggerName"], "str"),
    "file": (["file", "fileName", "file_name"], "str"),
    "line": (["line", "lineNumber", "line_number"], "uint"),
    "function": (["function", "methodName", "method_name"], "str"),
    "response_bytes": (["response_bytes", "body_bytes_sent"], "strnum"),
    "request_duration": (["request_duration", "request_time"], "strnum"),
    "upstream_time": (["upstream_time", "upstream_response_time"], "strnum"),
    "upstream_header_time": (["upstream_header_time"], "strnum"),
    "upstream_server": (["upstream_server", "upstream_addr"], "str"),
    "upstream_status": (["upstream_status"], "strnum"),
    "path": (["path", "uri"], "str"),
    "query_args": (["query_args", "args"], "str"),
    "request_size": (["request_size", "request_length"], "strnum"),
    "trace_id": (["trace_id", "traceId"], "str"),
    "span_id": (["span_id", "spanId"], "str"),
    "trace_flags": (["trace_flags", "traceFlags"], "str"),
    "resource": (["resource"], "any"),
    "log": (["log"], "str"),
    "stream": (["stream"], "str"),
    "namespace": (["namespace"], "str"),
    "pod": (["pod", "pod_name"], "str"),
    "container": (["container", "container_name"], "str"),
    "node": (["node", "node_name"], "str"),
}
TIME_ONLY = {"timestamp": (TIME_NAMES, "ts")}

#: Logfmt keys of level, message and time, in the order of preference.
LOGFMT_LEVEL = ["level", "lvl", "severity"]
LOGFMT_MESSAGE = ["message", "msg"]
LOGFMT_TIME = ["timestamp", "ts", "time"]

#: Status codes that are shown with their reason.
REASONS = {
    200: "OK",
    201: "Created",
    204: "No Content",
    400: "Bad Request",
    401: "Unauthorized",
    403: "Forbidden",
    404: "Not Found",
    405: "Method Not Allowed",
    500: "Internal Server Error",
    502: "Bad Gateway",
    503: "Service Unavailable",
}


def names(fields: dict) -> list[str]:
    return [n for own, _ in fields.values() for n in own]


def aliases(fields: dict) -> dict[str, str]:
    return {n: f for f, (own, _) in fields.items() for n in own}
