"""Where rows come from: definition files, container logs, sensor observations."""
