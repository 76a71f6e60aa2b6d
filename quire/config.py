"""Settings with defaults; unknown ones are refused."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    min_pages: int = 3
    use_repeated: bool = True
    use_noise: bool = True
    use_margin: bool = False
    use_markdown: bool = True
    use_thinning: bool = False
    adaptive: bool = False
    order: str = "page"
    thin_threshold: int | None = None
    summaries: bool = False

    def having(self, **changes) -> Settings:
        if unknown := set(changes) - {f.name for f in fields(self)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **changes)
