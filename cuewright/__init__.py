"""cuewright: scene-to-sound analytics as DataFrame transforms."""
