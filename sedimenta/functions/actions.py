"""Registry of actions: parameters with their types and ranges, and command templates.  Fixed values throughout."""

from __future__ import annotations

NAME = r"^[a-z0-9][a-z0-9\-]{0,62}$"

#: action, parameter, type, required, least, most, pattern
PARAMETERS = [
    ("oneke.namespace.create", "name", "str", True, None, None, NAME),
    ("oneke.namespace.create", "labels", "map", False, None, None, None),
    ("oneke.namespace.create", "annotations", "map", False, None, None, None),
    ("oneke.namespace.delete", "name", "str", True, None, None, None),
    ("oneke.namespace.list", "label_selector", "str", False, None, None, None),
    ("oneke.app.deploy", "chart", "str", True, None, None, None),
    ("oneke.app.deploy", "namespace", "str", True, None, None, None),
    ("oneke.app.deploy", "release_name", "str", True, None, None, None),
    ("oneke.app.deploy", "values", "map", False, None, None, None),
    ("oneke.app.deploy", "version", "str", False, None, None, None),
    ("oneke.app.deploy", "repo_url", "str", False, None, None, None),
    ("oneke.app.deploy", "create_namespace", "bool", False, None, None, None),
    ("oneke.app.deploy", "wait", "bool", False, None, None, None),
    ("oneke.app.uninstall", "release_name", "str", True, None, None, None),
    ("oneke.app.uninstall", "namespace", "str", True, None, None, None),
    ("oneke.app.uninstall", "keep_history", "bool", False, None, None, None),
    ("oneke.app.upgrade", "chart", "str", True, None, None, None),
    ("oneke.app.upgrade", "release_name", "str", True, None, None, None),
    ("oneke.app.upgrade", "namespace", "str", True, None, None, None),
    ("oneke.app.upgrade", "values", "map", False, None, None, None),
    ("oneke.app.upgrade", "version", "str", False, None, None, None),
    ("oneke.app.upgrade", "reuse_values", "bool", False, None, None, None),
    ("oneke.app.list", "namespace", "str", False, None, None, None),
    ("oneke.app.wait_ready", "namespace", "str", True, None, None, None),
    ("oneke.app.wait_ready", "label_selector", "str", True, None, None, None),
    ("oneke.app.wait_ready", "timeout_seconds", "int", False, 30, 1800, None),
    ("oneke.app.wait_ready", "expected_replicas", "int", False, None, None, None),
    ("oneke.app.get_status", "release_name", "str", True, None, None, None),
    ("oneke.app.get_status", "namespace", "str", True, None, None, None),
    ("oneke.service.get_endpoint", "namespace", "str", True, None, None, None),
    ("oneke.service.get_endpoint", "service_name", "str", True, None, None, None),
    ("oneke.service.expose", "namespace", "str", True, None, None, None),
    ("oneke.service.expose", "deployment_name", "str", True, None, None, None),
    ("oneke.service.expose", "port", "int", True, 1, 65535, None),
    ("oneke.service.expose", "target_port", "int", False, 1, 65535, None),
    ("oneke.service.expose", "service_type", "str", False, None, None, None),
    ("oneke.service.expose", "service_name", "str", False, None, None, None),
    ("oneke.service.list", "namespace", "str", False, None, None, None),
    ("oneke.storage.create_pvc", "name", "str", True, None, None, None),
    ("oneke.storage.create_pvc", "namespace", "str", True, None, None, None),
    ("oneke.storage.create_pvc", "size", "str", True, None, None, None),
    ("oneke.storage.create_pvc", "storage_class", "str", False, None, None, None),
    ("oneke.storage.create_pvc", "access_mode", "str", False, None, None, None),
    ("oneke.storage.list_pvcs", "namespace", "str", False, None, None, None),
    ("oneke.storage.delete_pvc", "name", "str", True, None, None, None),
    ("oneke.storage.delete_pvc", "namespace", "str", True, None, None, None),
    ("oneke.cluster.get_info", "cluster_name", "str", False, None, None, None),
    ("oneke.cluster.get_status", "cluster_name", "str", False, None, None, None),
    ("oneke.cluster.list_nodes", "cluster_name", "str", False, None, None, None),
    ("oneke.cluster.list_nodes", "role", "str", False, None, None, None),
    ("oneke.cluster.scale_nodes", "cluster_name", "str", False, None, None, None),
    ("oneke.cluster.scale_nodes", "worker_count", "int", True, 1, 100, None),
    ("oneke.cluster.scale_nodes", "node_template", "str", False, None, None, None),
    ("one.vm.create", "template_id", "int", True, None, None, None),
    ("one.vm.create", "name", "str", True, None, None, None),
    ("one.vm.create", "cpu", "float", False, 0.1, None, None),
    ("one.vm.create", "memory_mb", "int", False, 128, None, None),
    ("one.vm.create", "hold", "bool", False, None, None, None),
    ("one.vm.create", "extra_template", "str", False, None, None, None),
    ("one.vm.delete", "vm_id", "int", True, None, None, None),
    ("one.vm.poweroff", "vm_id", "int", True, None, None, None),
    ("one.vm.poweroff", "hard", "bool", False, None, None, None),
    ("one.vm.resume", "vm_id", "int", True, None, None, None),
    ("one.vm.list", "filter_flag", "int", False, None, None, None),
    ("one.vm.resize", "vm_id", "int", True, None, None, None),
    ("one.vm.resize", "cpu", "float", False, 0.1, None, None),
    ("one.vm.resize", "memory_mb", "int", False, 128, None, None),
    ("one.vm.resize", "enforce", "bool", False, None, None, None),
    ("one.vm.snapshot_create", "vm_id", "int", True, None, None, None),
    ("one.vm.snapshot_create", "snapshot_name", "str", False, None, None, None),
]
ACTIONS = sorted({p[0] for p in PARAMETERS})

#: action -> commands.  {p}: parameter, required; {p|x}: with a default; [p: ...]: only if p is given and not false;
#: [p=true: ...]: unless p is false.  ``each p``: a command per entry of a map (key, value); ``if p``: only if p is given;
#: ``log``: a message; ``vm``: a call of the machine interface.
COMMANDS = {
    "oneke.namespace.create": ["kubectl create namespace {name}", "each labels: kubectl label namespace {name} {key}={value}", "each annotations: kubectl annotate namespace {name} {key}={value}"],
    "oneke.namespace.delete": ["kubectl delete namespace {name} --ignore-not-found"],
    "oneke.namespace.list": ["kubectl get namespaces [label_selector: -l {label_selector}]"],
    "oneke.app.deploy": [
        "if repo_url: helm repo add {repo_name} {repo_url}", "if repo_url: helm repo update",
        "helm install {release_name} {chart} --namespace {namespace} [create_namespace=true: --create-namespace] [version: --version {version}] [wait=true: --wait --timeout {timeout}s] [values: -f {values}]",
    ],
    "oneke.app.uninstall": ["helm uninstall {release_name} --namespace {namespace} [keep_history: --keep-history]"],
    "oneke.app.upgrade": ["helm upgrade {release_name} {chart} --namespace {namespace} [version: --version {version}] [reuse_values=true: --reuse-values] --wait [values: -f {values}]"],
    "oneke.app.list": ["helm list [namespace: --namespace {namespace}] [!namespace: --all-namespaces]"],
    "oneke.app.wait_ready": ["log Waiting for pods to be ready (timeout: {timeout_seconds|300}s)...", "kubectl wait --for=condition=ready pod -l {label_selector} -n {namespace} --timeout={timeout_seconds|300}s"],
    "oneke.app.get_status": ["helm status {release_name} --namespace {namespace}"],
    "oneke.service.get_endpoint": ["kubectl get svc {service_name} -n {namespace} -o jsonpath={.status.loadBalancer.ingress[0].ip}"],
    "oneke.service.expose": ["kubectl expose deployment {deployment_name} --port={port} [target_port: --target-port={target_port}] --type={service_type|ClusterIP} -n {namespace} [service_name: --name={service_name}]"],
    "oneke.service.list": ["kubectl get svc [namespace: -n {namespace}] [!namespace: --all-namespaces]"],
    "oneke.storage.create_pvc": ["kubectl apply -f {manifest}"],
    "oneke.storage.list_pvcs": ["kubectl get pvc [namespace: -n {namespace}] [!namespace: --all-namespaces]"],
    "oneke.storage.delete_pvc": ["kubectl delete pvc {name} -n {namespace} --ignore-not-found"],
    "oneke.cluster.get_info": ["kubectl cluster-info"],
    "oneke.cluster.get_status": ["kubectl get nodes -o wide", "kubectl get pods --all-namespaces --field-selector=status.phase!=Running"],
    "oneke.cluster.list_nodes": ["kubectl get nodes -o wide [role: -l node-role.kubernetes.io/{role}]"],
    "oneke.cluster.scale_nodes": ["log Scaling workers to {worker_count} nodes via OneFlow...", "oneflow scale {cluster_name|default} worker {worker_count}"],
    "one.vm.create": ["vm allocate {template}"],
    "one.vm.delete": ["vm terminate-hard {vm_id}"],
    "one.vm.poweroff": ["vm poweroff {vm_id}"],
    "one.vm.resume": ["vm resume {vm_id}"],
    "one.vm.list": ["vm list"],
}
DESTRUCTIVE = ["oneke.namespace.delete", "one.vm.delete", "oneke.app.uninstall"]
RISKS = ["low", "medium", "high", "critical"]
ON_FAILURE = ["rollback", "abort", "continue", "retry"]
CHECKS = ["cluster_reachable", "namespace_available", "namespace_exists", "pods_running", "service_available", "vm_exists", "resource_available", "helm_repo_available"]
