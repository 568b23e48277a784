"""A knowledge-base service behind a REST interface: upload, poll, attach, list. Files go one by one from the
driver; it is an outlet for finished files, not part of any distributed plan."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from vellum.errors import FetchError, InvalidRequest, VellumError

#: Seconds of the first and the longest pause between two polls.
FIRST_PAUSE, LONGEST_PAUSE = 0.2, 2.0


def poll(probe: Callable[[], str], deadline_seconds: float, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> str:
    """Asks until the state is neither pending nor processing, with pauses that double from FIRST_PAUSE to
    LONGEST_PAUSE. Returns the last state; "timeout" after the deadline."""
    end, pause = clock() + deadline_seconds, FIRST_PAUSE
    while True:
        state = probe()
        if state not in ("pending", "processing"):
            return state
        if clock() + pause > end:
            return "timeout"
        sleep(pause)
        pause = min(LONGEST_PAUSE, pause * 2)


@dataclass(frozen=True)
class RemoteBases:
    """Client of the service at url with a bearer token."""

    url: str
    token: str
    timeout: float = 30.0

    def _call(self, method: str, path: str, body: bytes | None = None, content_type: str = "application/json") -> object:
        request = urllib.request.Request(f"{self.url.rstrip('/')}{path}", data=body, method=method, headers={"Authorization": f"Bearer {self.token}", "Content-Type": content_type, "Accept": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                text = reply.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            raise FetchError(f"{method} {path}: status {e.code}") from e
        return json.loads(text) if text.strip() else None

    def list(self) -> list[dict]:
        """All knowledge bases; none if the service gives null."""
        page = self._call("GET", "/api/v1/knowledge/")
        items = page.get("items") if isinstance(page, dict) else page
        return items or []

    def find_or_create(self, name: str, description: str = "") -> dict:
        if not name or not name.strip():
            raise InvalidRequest("a knowledge base needs a name")
        for base in self.list():
            if base.get("name") == name:
                return base
        return self._call("POST", "/api/v1/knowledge/create", json.dumps({"name": name, "description": description or name}).encode())

    def upload(self, filename: str, content: bytes, content_type: str) -> str:
        """Uploads a file and returns its id."""
        mark = uuid.uuid4().hex
        head = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{filename}"\r\nContent-Type: {content_type}\r\n\r\n'
        body = head.encode() + content + f"\r\n--{mark}--\r\n".encode()
        return self._call("POST", "/api/v1/files/", body, f"multipart/form-data; boundary={mark}")["id"]

    def file_status(self, file_id: str) -> str:
        reply = self._call("GET", f"/api/v1/files/{urllib.parse.quote(file_id)}/process/status")
        return (reply or {}).get("status", "unknown")

    def attach(self, base_id: str, file_id: str) -> None:
        self._call("POST", f"/api/v1/knowledge/{urllib.parse.quote(base_id)}/file/add", json.dumps({"file_id": file_id}).encode())

    def ingest(self, base: str, filename: str, content: bytes, content_type: str, wait_seconds: float = 60.0) -> dict:
        """Uploads, waits until the file is processed and adds it to the base."""
        target = self.find_or_create(base)
        file_id = self.upload(filename, content, content_type)
        state = poll(lambda: self.file_status(file_id), wait_seconds)
        if state == "failed":
            raise VellumError(f"{filename}: the service could not process it")
        if state != "timeout":
            self.attach(target["id"], file_id)
        return {"base": target["id"], "file_id": file_id, "status": state}
