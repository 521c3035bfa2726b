"""Options of a run: defaults, checks, and the arguments and summaries made of them. Plain values of the driver."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: Enhancement steps by mode, in their order.
RECIPES = {
    "bw": ("level", "unsharp"),
    "smooth": ("level", "unsharp"),
    "mrc": (),
    "vector": ("level", "sigmoidal", "unsharp"),
    "gray": ("level", "sigmoidal", "unsharp"),
    "color": ("level", "sigmoidal", "modulate", "unsharp"),
}


@dataclass(frozen=True)
class Options:
    """A scan run; None stands for the mode's default."""

    mode: str = "bw"
    width: int | None = None
    quality: int = 45
    threshold: str | None = None
    enhance: bool = False
    supersample: int = 1
    covers: str = "first,last"
    cover_width: int = 1400
    probe_pages: int = 8

    def settled(self) -> Options:
        """With the mode's defaults filled in and a percent sign on the threshold; refuses what cannot work."""
        width = self.width if self.width is not None else 1400 if self.mode == "smooth" else 1800
        threshold = self.threshold or ("58%" if self.enhance else "55%")
        if self.mode not in RECIPES:
            raise ValueError(f"unknown mode {self.mode}")
        if width < 200 and width != 0:
            raise ValueError("a width under 200 is none, and 0 keeps the scan's own")
        return Options(**{f.name: getattr(self, f.name) for f in fields(self)} | {"width": width, "threshold": threshold.rstrip("%") + "%"})

    @classmethod
    def saved(cls, values: dict) -> Options:
        """Saved values over today's defaults: unknown names are left out, nulls and values of another type are defaults."""
        known = {f.name: f.default for f in fields(cls)}
        kept = {k: v for k, v in values.items() if k in known and v is not None and (known[k] is None or isinstance(v, type(known[k])))}
        return cls(**kept)

    def arguments(self) -> list[str]:
        """Only what differs from the defaults, in the order of the fields."""
        out = []
        for f in fields(self):
            value = getattr(self, f.name)
            if value != f.default and value is not None:
                out += [f"--{f.name.replace('_', '-')}"] + ([] if value is True else [str(value)])
        return out


def check_paths(inputs: list[str], dest: str, least: int = 1) -> None:
    """Refuses too few inputs and a destination that is an input."""
    if len(inputs) < least:
        raise ValueError(f"at least {least} inputs are needed")
    if dest in inputs:
        raise ValueError("the destination is one of the inputs")


def job_threads(cores: int, jobs: int) -> int:
    """Threads of one of several jobs that run at once."""
    return max(2, cores // max(1, jobs))


def usable_languages(wanted: list[str], supported: list[str], default: str) -> list[str]:
    """Wanted languages that are supported, in their order; the default if there are none."""
    return [x for x in wanted if x in supported] or [default]


def migrated(value: str | None, legacy: tuple[str, ...], default: str) -> str:
    """A saved value, or today's default where nothing was saved or it was the default of an earlier version."""
    return default if value is None or value in legacy else value
