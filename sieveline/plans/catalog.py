"""Definitions that come with the library. More are loaded from TOML files or folders by ``filters.load``."""

from __future__ import annotations

from .filters import FilterDef

BLANK = r"^\s*$"

# Commands, what is stripped from their output, and caps, by name.
DEFS = [
    FilterDef("ansible-playbook", r"^ansible-playbook\b", True, strip_lines_matching=(BLANK, r"^ok: \[", r"^skipping: \["), max_lines=60),
    FilterDef("basedpyright", r"^basedpyright\b", True, strip_lines_matching=(BLANK, "^Searching for source files", r"^Found \d+ source file", r"^Pyright \d+\.\d+", r"^basedpyright \d+\.\d+"), max_lines=50, on_empty="basedpyright: ok"),
    FilterDef("biome", r"^biome\b", True, strip_lines_matching=(BLANK, r"^Checked \d+ file", r"^Fixed \d+ file", "^The following command", "^Run it with"), max_lines=50, on_empty="biome: ok"),
    FilterDef("brew-install", r"^brew\s+(install|upgrade)\b", True, match_output=(("already installed", "ok (already installed)", None),), strip_lines_matching=(BLANK, "^==> Downloading", "^==> Pouring", "^Already downloaded:", "^###", "^==> Fetching"), max_lines=20),
    FilterDef("bundle-install", r"^bundle\s+(install|update)\b", True, match_output=(("Bundle complete!", "ok bundle: complete", None), ("Bundle updated!", "ok bundle: updated", None)), strip_lines_matching=("^Using ", BLANK, "^Fetching gem metadata", "^Resolving dependencies"), max_lines=30),
    FilterDef("composer-install", r"^composer\s+(install|update|require)\b", True, match_output=(("Nothing to install, update or remove", "ok (up to date)", None),), strip_lines_matching=(BLANK, "^  - Downloading ", "^  - Installing ", "^Loading composer", "^Updating dependencies"), max_lines=30),
    FilterDef("df", r"^df(\s|$)", True, truncate_lines_at=80, max_lines=20),
    FilterDef("dotnet-build", r"^dotnet\s+build\b", True, match_output=((r"0 Warning\(s\)\n\s+0 Error\(s\)", "ok (build succeeded)", None),), strip_lines_matching=(BLANK, r"^Microsoft \(R\)", r"^Copyright \(C\)", "^  Determining projects"), max_lines=40),
    FilterDef("du", r"^du\b", strip_lines_matching=(BLANK,), truncate_lines_at=120, max_lines=40),
    FilterDef("fail2ban-client", r"^fail2ban-client\b", strip_lines_matching=(BLANK,), max_lines=30),
    FilterDef("gcc", r"^g(cc|\+\+)\b", True, strip_lines_matching=(BLANK, r"^\s+\|\s*$", "^In file included from", r"^\s+from\s", r"^\d+ warnings? generated", r"^\d+ errors? generated"), max_lines=50, on_empty="gcc: ok"),
    FilterDef("gcloud", r"^gcloud\b", True, strip_lines_matching=(BLANK,), truncate_lines_at=120, max_lines=30),
    FilterDef("gradle", r"^(gradle|gradlew|\./)gradlew?\b", True, strip_lines_matching=(BLANK, "^> Configuring project", "^> Resolving dependencies", "^> Transform ", r"^Download(ing)?\s+http", r"^\s*<-+>\s*$", "^> Task :.*UP-TO-DATE$", "^> Task :.*NO-SOURCE$", "^> Task :.*FROM-CACHE$", "^Starting a Gradle Daemon", "^Daemon will be stopped"), truncate_lines_at=150, max_lines=50, on_empty="gradle: ok"),
    FilterDef("hadolint", r"^hadolint\b", True, strip_lines_matching=(BLANK,), truncate_lines_at=120, max_lines=40),
    FilterDef("helm", r"^helm\b", True, strip_lines_matching=(BLANK, r"^W\d{4}"), truncate_lines_at=120),
    FilterDef("iptables", r"^iptables\b", strip_lines_matching=(BLANK, "^Chain DOCKER", "^Chain BR-"), truncate_lines_at=120, max_lines=50),
    FilterDef("jira", r"^jira\b", True, strip_lines_matching=(BLANK, r"^\s*--"), truncate_lines_at=120, max_lines=40),
    FilterDef("jj", r"^jj\b", True, strip_lines_matching=(BLANK, "^Hint:", "^Working copy now at:"), truncate_lines_at=120, max_lines=30),
    FilterDef("jq", r"^jq\b", True, strip_lines_matching=(BLANK,), truncate_lines_at=120, max_lines=40),
    FilterDef("just", r"^just\b", True, strip_lines_matching=(BLANK, r"^\s*Available recipes:", r"^\s*just --list"), truncate_lines_at=150, max_lines=50),
    FilterDef("liquibase", r"(?:^|/)liquibase(?:\s|$)", True, strip_lines_matching=(BLANK, "^Starting Liquibase at", "^Liquibase (?:Community|Open Source)", "^Liquibase Home:", "^Java Home", "^Libraries:", r"^\s*-\s+\S+\.jar", r"^INFO \[liquibase\.integration\]", r"^INFO \[liquibase\.core\] Reading resource", r"^INFO \[liquibase\.core\] Parsing", r"^(?:\[?INFO\]?\s*)?#+$", r"^\s*##"), max_lines=200, on_empty="liquibase: ok", filter_stderr=True),
    FilterDef("make", r"^make\b", strip_lines_matching=(r"^make\[\d+\]:", BLANK, "^Nothing to be done"), max_lines=50, on_empty="make: ok"),
    FilterDef("markdownlint", r"^markdownlint\b", True, strip_lines_matching=(BLANK,), truncate_lines_at=120, max_lines=50),
    FilterDef("mise", r"^mise\s+(run|exec|install|upgrade)\b", True, strip_lines_matching=(BLANK, r"^mise\s+(trust|install|upgrade).*✓", r"^mise\s+Installing\s", r"^mise\s+Downloading\s", r"^mise\s+Extracting\s", r"^mise\s+\w+@[\d.]+ installed"), truncate_lines_at=150, max_lines=50, on_empty="mise: ok"),
    FilterDef("mix-compile", r"^mix\s+compile(\s|$)", True, strip_lines_matching=(r"^Compiling \d+ file", BLANK, r"^Generated\s"), max_lines=40, on_empty="mix compile: ok"),
    FilterDef("mix-format", r"^mix\s+format(\s|$)", max_lines=20, on_empty="mix format: ok"),
    FilterDef("nx", r"^(pnpm\s+)?nx\b", True, strip_lines_matching=(BLANK, r"^\s*>\s*NX\s+Running target", r"^\s*>\s*NX\s+Nx read the output", r"^\s*>\s*NX\s+View logs", "^———————", "^—————————", r"^\s+Nx \(powered by"), truncate_lines_at=150, max_lines=60),
    FilterDef("ollama", r"^ollama\s+run\b", True, strip_lines_matching=(r"^[⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏\s]*$", BLANK)),
    FilterDef("oxlint", r"^oxlint\b", True, strip_lines_matching=(BLANK, r"^Finished in \d+", r"^Found \d+ warning"), max_lines=50, on_empty="oxlint: ok"),
    FilterDef("ping", r"^ping\b", True, strip_lines_matching=("^PING ", "^Pinging ", r"^\d+ bytes from ", "^Reply from .+: bytes=", BLANK), tail_lines=4),
    FilterDef("pio-run", r"^pio\s+run", True, strip_lines_matching=(BLANK, "^Verbose mode", "^CONFIGURATION:", "^LDF:", "^Library Manager:", r"^Compiling\s", r"^Linking\s", r"^Building\s", "^Checking size"), max_lines=30, on_empty="pio run: ok"),
    FilterDef("poetry-install", r"^poetry\s+(install|lock|update)\b", True, match_output=((r"No dependencies to install or update|No changes\.", "ok (up to date)", None),), strip_lines_matching=(BLANK, "^  [-•] Downloading ", r"^  [-•] Installing .* \(", "^Creating virtualenv", "^Using virtualenv"), max_lines=30),
    FilterDef("pre-commit", r"^pre-commit\b", True, strip_lines_matching=(r"^\[INFO\] Installing environment", r"^\[INFO\] Once installed this environment will be reused", r"^\[INFO\] This may take a few minutes", BLANK), max_lines=40),
    FilterDef("ps", r"^ps(\s|$)", True, truncate_lines_at=120, max_lines=30),
    FilterDef("quarto-render", r"^quarto\s+render", True, match_output=(("Output created:", "ok (output created)", None),), strip_lines_matching=(BLANK, r"^\s*processing file:", r"^\s*\d+/\d+\s", r"^\s*running", r"^\s*Rendering", "^pandoc ", "^  Validating", "^  Resolving"), max_lines=20),
    FilterDef("rsync", r"^rsync\b", True, match_output=(("total size is", "ok (synced)", "error|failed|No such file"),), strip_lines_matching=(BLANK, "^sending incremental file list", r"^sent \d"), max_lines=20),
    FilterDef("shellcheck", r"^shellcheck\b", True, strip_lines_matching=(BLANK,), max_lines=50),
    FilterDef("shopify-theme", r"^shopify\s+theme\s+(push|pull)", True, strip_lines_matching=(BLANK, r"^\s*Uploading", r"^\s*Downloading"), tail_lines=5, max_lines=15, on_empty="shopify theme: ok"),
    FilterDef("skopeo", r"^skopeo\b", True, strip_lines_matching=(BLANK, "^Getting image source signatures", "^Copying blob", "^Copying config", "^Writing manifest", "^Storing signatures"), truncate_lines_at=120, max_lines=30, on_empty="skopeo: ok"),
    FilterDef("sops", r"^sops\b", True, strip_lines_matching=(BLANK,), max_lines=40),
    FilterDef("spring-boot", r"^(mvn\s+spring-boot:run|java\s+-jar.*\.jar|gradle\s+.*bootRun)", True, keep_lines_matching=(r"Started\s.*\sin\s", "Tomcat started on port", "ERROR", "WARN", "Exception", "Caused by:", "Application run failed", r"BUILD\s", "Tests run:", "FAILURE", "listening on port"), max_lines=30),
    FilterDef("ssh", r"^ssh\b", True, strip_lines_matching=(BLANK, "^Warning: Permanently added", "^Connection to .+ closed", "^Authenticated to", "^debug1:", "^OpenSSH_", "^Pseudo-terminal"), truncate_lines_at=120, max_lines=200),
    FilterDef("stat", r"^stat\b", True, strip_lines_matching=(BLANK, r"^\s*Device:", r"^\s*Birth:"), truncate_lines_at=120, max_lines=20),
    FilterDef("swift-build", r"^swift\s+build\b", True, match_output=(("Build complete!", "ok (build complete)", "warning:|error:"),), strip_lines_matching=(BLANK, "^Compiling ", "^Linking "), max_lines=40),
    FilterDef("systemctl-status", r"^systemctl\s+status\b", True, strip_lines_matching=(BLANK,), max_lines=20),
    FilterDef("task", r"^task\b", True, strip_lines_matching=(BLANK, r"^task: \[.*\] ", "^task: Task .* is up to date"), truncate_lines_at=150, max_lines=50, on_empty="task: ok"),
    FilterDef("terraform-plan", r"^terraform\s+plan", True, strip_lines_matching=("^Refreshing state", r"^\s*#.*unchanged", BLANK, "^Acquiring state lock", "^Releasing state lock"), max_lines=80, on_empty="terraform plan: no changes detected"),
    FilterDef("tofu-fmt", r"^tofu\s+fmt(\s|$)", True, max_lines=30, on_empty="tofu fmt: ok (no changes)"),
    FilterDef("tofu-init", r"^tofu\s+init(\s|$)", True, strip_lines_matching=("^- Downloading", "^- Installing", "^- Using previously-installed", BLANK, "^Initializing provider", "^Initializing the backend", "^Initializing modules"), max_lines=20, on_empty="tofu init: ok"),
    FilterDef("tofu-plan", r"^tofu\s+plan(\s|$)", True, strip_lines_matching=("^Refreshing state", r"^\s*#.*unchanged", BLANK, "^Acquiring state lock", "^Releasing state lock"), max_lines=80, on_empty="tofu plan: no changes detected"),
    FilterDef("tofu-validate", r"^tofu\s+validate(\s|$)", True, match_output=(("Success! The configuration is valid", "ok (valid)", None),)),
    FilterDef("trunk-build", r"^trunk\s+build", True, strip_lines_matching=(BLANK, r"^\s*Compiling\s", r"^\s*Downloading\s", r"^\s*Fetching\s", r"^\s*Fresh\s", r"^\s*Checking\s"), tail_lines=10, max_lines=30, on_empty="trunk build: ok"),
    FilterDef("turbo", r"^turbo\b", True, strip_lines_matching=(BLANK, r"^\s*cache (hit|miss|bypass)", r"^\s*\d+ packages in scope", r"^\s*Tasks:\s+\d+", r"^\s*Duration:\s+", r"^\s*Remote caching (enabled|disabled)"), truncate_lines_at=150, max_lines=50, on_empty="turbo: ok"),
    FilterDef("ty", r"^ty\b", True, strip_lines_matching=(BLANK, r"^Checking \d+ file", r"^ty \d+\.\d+"), max_lines=50, on_empty="ty: ok"),
    FilterDef("uv-sync", r"^uv\s+(sync|pip\s+install)\b", True, match_output=((r"Audited \d+ package", "ok (up to date)", None),), strip_lines_matching=(BLANK, r"^\s+Downloading ", r"^\s+Using cached ", r"^\s+Preparing "), max_lines=20),
    FilterDef("xcodebuild", r"^xcodebuild\b", True, strip_lines_matching=(BLANK, r"^CompileC\s", r"^CompileSwift\s", r"^Ld\s", r"^CreateBuildDirectory\s", r"^MkDir\s", r"^ProcessInfoPlistFile\s", r"^CopySwiftLibs\s", r"^CodeSign\s", "^Signing Identity:", "^RegisterWithLaunchServices", r"^Validate\s", "^ProcessProductPackaging", r"^Touch\s", "^LinkStoryboards", "^CompileStoryboard", "^CompileAssetCatalog", "^GenerateDSYMFile", "^PhaseScriptExecution", r"^PBXCp\s", r"^SetMode\s", r"^SetOwnerAndGroup\s", r"^Ditto\s", r"^CpResource\s", r"^CpHeader\s", r"^\s+cd\s+/", r"^\s+export\s", r"^\s+/Applications/Xcode", r"^\s+/usr/bin/", r"^\s+builtin-", "^note: Using new build system"), max_lines=60, on_empty="xcodebuild: ok"),
    FilterDef("yadm", r"^yadm\b", True, strip_lines_matching=(BLANK, r'^\s*\(use "git ', r'^\s*\(use "yadm '), truncate_lines_at=120, max_lines=40),
    FilterDef("yamllint", r"^yamllint\b", True, strip_lines_matching=(BLANK,), truncate_lines_at=120, max_lines=50),
]
