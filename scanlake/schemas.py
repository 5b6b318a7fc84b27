"""Report schemas (Spark DDL). Never inferred; each names only the fields that are read."""

CORRUPT = "_corrupt"

_VULN = (
    "VulnerabilityID:string,PkgName:string,InstalledVersion:string,FixedVersion:string,"
    "Severity:string,Title:string,Description:string"
)
_MISCONF = "ID:string,Type:string,Severity:string,Title:string,Resolution:string"
_SECRET = "RuleID:string,Category:string,Severity:string,Title:string,StartLine:string"

VULN_REPORT = (
    f"Results array<struct<Target:string,Vulnerabilities:array<struct<{_VULN}>>,"
    f"Misconfigurations:array<struct<{_MISCONF}>>,Secrets:array<struct<{_SECRET}>>>>"
)
# Counting needs one field of each finding, so that is all that is parsed.
SEVERITY_REPORT = (
    "Results array<struct<Vulnerabilities:array<struct<Severity:string>>,"
    "Misconfigurations:array<struct<Severity:string>>,Secrets:array<struct<Severity:string>>>>"
)

SBOM = (
    "bomFormat string, specVersion string, "
    "components array<struct<type:string,name:string,version:string,purl:string>>"
)
SBOM_TYPES = "bomFormat string, specVersion string, components array<struct<type:string>>"
NPM_LOCK = "packages map<string,struct<version:string>>, dependencies map<string,struct<version:string>>"
NPM_MANIFEST = "dependencies map<string,string>, devDependencies map<string,string>"

QUALITY_GATE = (
    "projectStatus struct<status:string,conditions:array<struct<metricKey:string,actualValue:string,"
    "errorThreshold:string,status:string>>>, status string"
)
MEASURES = "component struct<measures:array<struct<metric:string,value:string>>>"
QUALITY_ISSUES = (
    "issues array<struct<severity:string,type:string,message:string,component:string,rule:string>>"
)
SHELL_LINT = "array<struct<level:string>>"
DOCKER_LINT = "array<struct<level:string,code:string,message:string,file:string,line:string>>"
MATCH_REPORT = "matches array<struct<vulnerability:struct<severity:string>>>"
PY_LINT = "results array<struct<issue_severity:string>>"
JS_LINT = "array<struct<errorCount:int,warningCount:int>>"
ISTANBUL = "total struct<lines:struct<pct:double>>"
GO_TEST_EVENT = "Action string, Test string"

JUNIT = "_tests string, _failures string, _errors string, _skipped string, _time string, _broken string"
JUNIT_CASE = "_classname string, _name string, failure array<struct<_message:string>>"
COBERTURA = (
    "`_line-rate` string, `_branch-rate` string, `_lines-valid` string, `_lines-covered` string, "
    "packages struct<package:array<struct<_name:string,`_line-rate`:string>>>"
)

_COUNTS = "critical:bigint,high:bigint,medium:bigint,low:bigint,unknown:bigint"
SCAN_SUMMARY = (
    "scan_id string, scan_type string, timestamp string, gate_status string, gate_passed boolean, "
    f"totals struct<{_COUNTS}>, secrets_found bigint, sbom_component_count bigint, "
    f"sonarqube_quality_gate string, findings_by_scan map<string,struct<{_COUNTS},found:bigint,file:string>>"
)
UNIFIED_REPORT = (
    "scan_id string, mode string, strict boolean, adapters array<string>, "
    "summary struct<gate_verdict:struct<status:string,reasons:array<string>>,"
    "severity_totals:map<string,bigint>,warnings:array<string>,"
    "tool_status:map<string,struct<available:boolean,required:boolean>>>, "
    "findings_by_tool map<string,map<string,bigint>>, traceability map<string,string>"
)

BUILD = (
    "number bigint, result string, building boolean, timestamp bigint, duration bigint, url string, "
    "actions array<struct<parameters:array<struct<name:string,value:string>>>>, "
    "artifacts array<struct<fileName:string,relativePath:string>>"
)
NODES = (
    "computer array<struct<displayName:string,offline:boolean,idle:boolean,numExecutors:int>>"
)
PHASE_RECORD = (
    "scan_id string, name string, status string, started_at string, ended_at string, "
    "duration_ms bigint, details string"
)
