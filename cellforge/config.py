"""Settings, passed to the stages that need them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """All settings with their defaults; `with_changes` gives a changed copy."""

    silent_errors: bool = True
    store_adapter: str = "parquet"
    store_uri: str = ""
    store_user: str = ""
    store_password: str = ""
    store_database: str = ""
    keep_empty_documents: bool = True
    overwrite: bool = False
    #: Count columns over all rows of a table, not the first one only.
    careful: bool = True
    #: A row that can't be placed is left out; else its table is.
    ignore_bad_rows: bool = True
    exclude_unlabelled: bool = False
    use_readability: bool = False
    keep_html: bool = False
    #: Look for coordinate triplets in every column, those of standard kinds too.
    strict_parity: bool = True

    def with_changes(self, **changes: object) -> Settings:
        known = {f.name for f in fields(self)}
        if unknown := set(changes) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(self, **changes)

    def reset(self, name: str | None = None) -> Settings:
        """One setting, or all of them, at the default."""
        if name is None:
            return Settings()
        return self.with_changes(**{name: getattr(Settings(), name, None)})


DEFAULTS = Settings()
