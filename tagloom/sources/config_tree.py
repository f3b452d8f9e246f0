"""Settings of a detection run by dotted name, laid over a template; YAML where that is installed."""

from __future__ import annotations


def overlaid(template: dict, settings: dict[str, object]) -> dict:
    """A new tree: the template with each named setting in its place; a branch is made where there is none."""
    branches: dict[str, dict[str, object]] = {}
    out = dict(template)
    for name, value in settings.items():
        head, _, rest = name.partition(".")
        if rest:
            branches.setdefault(head, {})[rest] = value
        else:
            out[head] = value
    for head, below in branches.items():
        old = template.get(head)
        out[head] = overlaid(old if isinstance(old, dict) else {}, below)
    return out


def detection_settings(
    root: str, weights: str, save_dir: str, checkpoints: str | None = None, epochs: int = 50, batch_size: int = 8, workers: int = 4, amp: bool = False, rate: float = 1e-4
) -> dict[str, object]:
    """What a detection run sets: its model reads train and val labels; the test split is for measuring only."""
    root = root.rstrip("/")
    # Names and constants of the run's configuration.
    return {
        "Global.use_gpu": True,
        "Global.epoch_num": epochs,
        "Global.save_model_dir": save_dir,
        "Global.save_epoch_step": 5,
        "Global.eval_batch_step": [0, 200],
        "Global.pretrained_model": weights,
        "Global.checkpoints": checkpoints,
        "Global.use_amp": amp,
        "Global.print_batch_step": 20,
        "Global.use_visualdl": True,
        "Optimizer.lr.learning_rate": rate,
        "Train.dataset.data_dir": f"{root}/image_set",
        "Train.dataset.label_file_list": [f"{root}/labels/det_train.txt"],
        "Train.dataset.ratio_list": [1.0],
        "Train.loader.batch_size_per_card": batch_size,
        "Train.loader.num_workers": workers,
        "Train.loader.shuffle": True,
        "Train.loader.drop_last": False,
        "Eval.dataset.data_dir": f"{root}/image_set",
        "Eval.dataset.label_file_list": [f"{root}/labels/det_val.txt"],
        "Eval.loader.batch_size_per_card": 1,
        "Eval.loader.num_workers": max(workers // 2, 1),
        "Eval.loader.shuffle": False,
        "Eval.loader.drop_last": False,
    }


def read_yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def write_yaml(tree: dict, path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(tree, f, allow_unicode=True, sort_keys=False)
