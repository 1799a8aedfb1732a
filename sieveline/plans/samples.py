"""Own samples for the definitions of the catalog: a command that each takes, an output, and what is left of it. ``filters.verify`` runs them."""

from __future__ import annotations

import dataclasses

from .catalog import DEFS
from .filters import FilterDef

#: name -> (command, output, what is left)
SAMPLES: dict[str, tuple[str, str, str]] = {
    "ansible-playbook": ("ansible-playbook site.yml", "PLAY [all]\nok: [h1]\nskipping: [h2]\nchanged: [h1]\n", "PLAY [all]\nchanged: [h1]"),
    "basedpyright": ("basedpyright src", "Searching for source files\nFound 3 source files\n", "basedpyright: ok"),
    "biome": ("biome check", "Checked 3 files in 2ms\na.ts:1 bad\nRun it with --apply\n", "a.ts:1 bad"),
    "brew-install": ("brew install jq", "==> Downloading x\n==> Fetching jq\n==> Summary\n", "==> Summary"),
    "bundle-install": ("bundle install", "Using rake 1\nBundle complete! 3 gems\n", "ok bundle: complete"),
    "composer-install": ("composer install", "Loading composer repositories\n  - Installing a/b (1)\nGenerating autoload\n", "Generating autoload"),
    "df": ("df -h", "Filesystem Size\n/dev/sda1 10G\n", "Filesystem Size\n/dev/sda1 10G"),
    "dotnet-build": ("dotnet build", "Microsoft (R) Build\nBuild succeeded.\n    0 Warning(s)\n    0 Error(s)\n", "ok (build succeeded)"),
    "du": ("du -sh .", "\n12K\t./a\n\n", "12K\t./a"),
    "fail2ban-client": ("fail2ban-client status", "Status\n\n|- Number: 1\n", "Status\n|- Number: 1"),
    "gcc": ("gcc a.c", "In file included from a.h\na.c:1:2: error: x\n  |\n1 error generated.\n", "a.c:1:2: error: x"),
    "gcloud": ("gcloud list", "\nNAME\n\nvm1\n", "NAME\nvm1"),
    "gradle": ("gradlew build", "> Task :a UP-TO-DATE\n> Configuring project :a\n", "> Task :a UP-TO-DATE\n> Configuring project :a\n"),
    "hadolint": ("hadolint Dockerfile", "\nDockerfile:1 DL3006 x\n", "Dockerfile:1 DL3006 x"),
    "helm": ("helm list", "W1234 warning\nNAME\nweb\n", "NAME\nweb"),
    "iptables": ("iptables -L", "Chain INPUT\nChain DOCKER\nChain BR-1\nACCEPT\n", "Chain INPUT\nACCEPT"),
    "jira": ("jira issue list", "KEY\n  ----\nA-1\n", "KEY\nA-1"),
    "jj": ("jj log", "Hint: x\n@ a\nWorking copy now at: b\n", "@ a"),
    "jq": ("jq .", "{\n\n}\n", "{\n}"),
    "just": ("just", "Available recipes:\n  build\n", "  build"),
    "liquibase": ("liquibase update", "Starting Liquibase at x\n####\nINFO ####\n## x\nLibraries:\n- a.jar\n", "liquibase: ok"),
    "make": ("make all", "make[1]: Entering\n\nNothing to be done for all\n", "make: ok"),
    "markdownlint": ("markdownlint .", "\na.md:1 MD001\n", "a.md:1 MD001"),
    "mise": ("mise install", "mise Installing node\nmise node@20.1 installed\n", "mise: ok"),
    "mix-compile": ("mix compile", "Compiling 3 files (.ex)\nwarning: x\nGenerated app\n", "warning: x"),
    "mix-format": ("mix format", "", "mix format: ok"),
    "nx": ("pnpm nx test", " > NX   Running target test\n———————————\n ok a\n", " ok a"),
    "ollama": ("ollama run x", "⠋ \nHello\n\n", "Hello"),
    "oxlint": ("oxlint", "Found 0 warnings\nFinished in 3ms\n", "oxlint: ok"),
    "ping": ("ping host", "PING host\n64 bytes from 1\n\n--- stats\na\nb\nc\nd\n", "... (1 lines omitted)\na\nb\nc\nd"),
    "pio-run": ("pio run", "Verbose mode\nCompiling a\nLinking b\nerror: x\n", "error: x"),
    "poetry-install": ("poetry install", "Using virtualenv: x\nNo dependencies to install or update\n", "ok (up to date)"),
    "pre-commit": ("pre-commit run", "[INFO] Installing environment for x\nblack....Passed\n", "black....Passed"),
    "ps": ("ps aux", "PID CMD\n1 init\n", "PID CMD\n1 init"),
    "quarto-render": ("quarto render a.qmd", "processing file: a\n  1/3 x\npandoc a\nWARN y\n", "WARN y"),
    "rsync": ("rsync -a a b", "sending incremental file list\nx\ntotal size is 3\nrsync error: failed\n", "x\ntotal size is 3\nrsync error: failed"),
    "shellcheck": ("shellcheck a.sh", "\nIn a.sh line 1:\n", "In a.sh line 1:"),
    "shopify-theme": ("shopify theme push", "Uploading a\n Downloading b\n", "shopify theme: ok"),
    "skopeo": ("skopeo copy a b", "Getting image source signatures\nCopying blob x\nWriting manifest\n", "skopeo: ok"),
    "sops": ("sops -d a", "\nkey: v\n", "key: v"),
    "spring-boot": ("mvn spring-boot:run", "banner\nStarted App in 3 seconds\nDEBUG x\nERROR y\n", "Started App in 3 seconds\nERROR y"),
    "ssh": ("ssh host ls", "Warning: Permanently added x\ndebug1: y\na.txt\n", "a.txt"),
    "stat": ("stat a", "  File: a\nDevice: 1\n Birth: -\n", "  File: a"),
    "swift-build": ("swift build", "Compiling a\nwarning: x\nBuild complete!\n", "warning: x\nBuild complete!"),
    "systemctl-status": ("systemctl status x", "● x\n\n   Active\n", "● x\n   Active"),
    "task": ("task build", "task: [build] go\ntask: Task \"x\" is up to date\n", "task: ok"),
    "terraform-plan": ("terraform plan", "Refreshing state... x\n  # a will be unchanged\n", "terraform plan: no changes detected"),
    "tofu-fmt": ("tofu fmt", "\n", "tofu fmt: ok (no changes)"),
    "tofu-init": ("tofu init", "Initializing the backend...\n- Installing x\n", "tofu init: ok"),
    "tofu-plan": ("tofu plan", "Acquiring state lock\n+ create\nReleasing state lock\n", "+ create"),
    "tofu-validate": ("tofu validate", "\x1b[32mSuccess! The configuration is valid.\x1b[0m\n", "ok (valid)"),
    "trunk-build": ("trunk build", "  Compiling a\n  Fresh b\n", "trunk build: ok"),
    "turbo": ("turbo run build", " cache miss, executing\n Tasks:    3\nfailed x\n", "failed x"),
    "ty": ("ty check", "Checking 3 files\n", "ty: ok"),
    "uv-sync": ("uv sync", "   Downloading a\nInstalled 3\n", "Installed 3"),
    "xcodebuild": ("xcodebuild", "CompileC a\n    cd /x\n    builtin-copy\nnote: Using new build system\n", "xcodebuild: ok"),
    "yadm": ("yadm status", "On branch x\n  (use \"git add\" y)\n", "On branch x"),
    "yamllint": ("yamllint .", "\na.yml\n", "a.yml"),
}
# what a wrapper in front of a build tool prints isn't routed: the pattern wants the tool's name twice or a path before it
SAMPLES["gradle"] = ("./gradlew build", "> Task :a UP-TO-DATE\n> Configuring project :a\n", "gradle: ok")


def with_samples() -> list[FilterDef]:
    """The catalog with its samples as tests."""
    return [dataclasses.replace(d, tests=(("own", *SAMPLES[d.name][1:]),)) for d in DEFS]
