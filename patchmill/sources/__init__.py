"""Sources and sinks: files, images, manifests, runs."""
