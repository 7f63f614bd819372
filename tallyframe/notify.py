"""Notices of results to HTTP services, from the driver."""

from __future__ import annotations

import json
import urllib.request
from typing import Any


class HttpClient:
    """JSON over HTTP."""

    def __init__(self, base_url: str = "", headers: dict[str, str] | None = None, timeout: float = 30.0) -> None:
        self.base_url, self.headers, self.timeout = base_url.rstrip("/"), headers or {}, timeout

    def request(self, method: str, path: str, body: Any = None) -> Any:
        url = f"{self.base_url}/{path.lstrip('/')}" if self.base_url and not path.startswith("http") else path
        data = None if body is None else json.dumps(body).encode()
        req = urllib.request.Request(url, data, {"Content-Type": "application/json", **self.headers}, method=method)
        with urllib.request.urlopen(req, timeout=self.timeout) as r:  # noqa: S310
            text = r.read().decode()
        try:
            return json.loads(text)
        except ValueError:
            return text

    def get(self, path: str) -> Any:
        return self.request("GET", path)

    def post(self, path: str, body: Any) -> Any:
        return self.request("POST", path, body)

    def put(self, path: str, body: Any) -> Any:
        return self.request("PUT", path, body)


def reconciliation_text(report: dict[str, Any]) -> str:
    """A reconciliation's figures in words."""
    return (
        f"Reconciliation of {report.get('source_a', 'A')} and {report.get('source_b', 'B')}: {report.get('matches', 0)} matches, "
        f"{report.get('conflicts', 0)} conflicts, {report.get('orphans_left', 0)} only in the first, {report.get('orphans_right', 0)} only in the second"
    )


class ChatNotifier(HttpClient):
    """Messages to a chat webhook."""

    def __init__(self, webhook: str, **options: Any) -> None:
        super().__init__("", **options)
        self.webhook = webhook

    def send(self, text: str, blocks: list[dict] | None = None) -> Any:
        return self.post(self.webhook, {"text": text, **({"blocks": blocks} if blocks else {})})

    def send_reconciliation(self, report: dict[str, Any]) -> Any:
        text = reconciliation_text(report)
        return self.send(text, [{"type": "section", "text": {"type": "mrkdwn", "text": text}}])

    def send_notice(self, workflow: str, status: str, details: str = "") -> Any:
        return self.send(f"{workflow}: {status}" + (f" - {details}" if details else ""))
