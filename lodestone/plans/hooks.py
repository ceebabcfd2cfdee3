"""Git hooks that scan what is committed or pushed: installed with a backup of what was there, and taken out again."""

from __future__ import annotations

import shlex
import subprocess
from pathlib import Path

MARK = "# installed by lodestone"
HOOKS = {"pre-commit": ("--staged", "critical"), "pre-push": ("--since @{upstream}", "high")}


def folder(repository: str = ".") -> Path | None:
    """The hooks' folder of a repository; None outside of one."""
    found = subprocess.run(["git", "-C", repository, "rev-parse", "--absolute-git-dir"], capture_output=True, text=True)
    hooks = Path(found.stdout.strip()) / "hooks"
    return hooks if found.returncode == 0 and hooks.is_dir() else None


def script(name: str, threshold: str, rules: str | None) -> str:
    """A hook's text; the threshold and the rules' folder can be set in the environment, else the starter rules scan."""
    scope = HOOKS[name][0]
    return f"""#!/bin/sh
{MARK}
threshold="${{LODESTONE_THRESHOLD:-{threshold}}}"
rules="${{LODESTONE_RULES:-{shlex.quote(rules) if rules else ''}}}"
command -v python3 >/dev/null 2>&1 || {{ echo "python3 not found, nothing scanned" >&2; exit 0; }}
exec python3 -m lodestone.plans.cli "$(git rev-parse --show-toplevel)" ${{rules:+--rules "$rules"}} {scope} --fail-on "$threshold"
"""


def _backup(hook: Path) -> Path | None:
    """Move a hook aside under the first free name."""
    if not hook.exists():
        return None
    names = (hook.with_name(f"{hook.name}.backup{f'.{k}' if k else ''}") for k in range(10_000))
    free = next(n for n in names if not n.exists())
    return hook.rename(free)


def install(repository: str = ".", names: tuple[str, ...] = tuple(HOOKS), thresholds: dict[str, str] | None = None, rules: str | None = None) -> list[str]:
    """Install hooks; returns a line for each.  Raises outside a repository."""
    hooks, said = folder(repository), []
    if hooks is None:
        raise FileNotFoundError(f"no git repository at {repository}")
    for name in names:
        kept = _backup(hooks / name)
        (hooks / name).write_text(script(name, (thresholds or {}).get(name, HOOKS[name][1]), rules))
        (hooks / name).chmod(0o755)
        said.append(f"installed {name}" + (f" (backup: {kept.name})" if kept else ""))
    return said


def uninstall(repository: str = ".", names: tuple[str, ...] = tuple(HOOKS), restore: bool = True) -> list[str]:
    """Remove hooks that install() wrote, and bring back the first backup; returns a line for each."""
    hooks, said = folder(repository), []
    if hooks is None:
        raise FileNotFoundError(f"no git repository at {repository}")
    for name in names:
        hook, backup = hooks / name, hooks / f"{name}.backup"
        if not hook.exists():
            said.append(f"{name}: not installed")
        elif MARK not in hook.read_text():
            said.append(f"{name}: not one of ours")
        else:
            hook.unlink()
            if restore and backup.exists():
                backup.rename(hook)
                said.append(f"{name}: removed, backup restored")
            else:
                said.append(f"{name}: removed")
    return said
