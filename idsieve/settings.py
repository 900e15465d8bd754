"""Plain parameters of the screening jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    max_upload_bytes: int = 10 * 1024 * 1024
    max_image_pixels: int = 40_000_000
    allowed_extensions: tuple[str, ...] = (".png", ".jpg", ".jpeg", ".webp", ".pdf")
    allow_pdf: bool = True
    retain_uploads: bool = False
    upload_ttl_seconds: int = 3600
    rate_limit: int = 30
    rate_window_seconds: int = 60
    session_ttl_seconds: int = 600

    @property
    def extensions(self) -> list[str]:
        return [e for e in self.allowed_extensions if self.allow_pdf or e != ".pdf"]


DEFAULT = Settings()
