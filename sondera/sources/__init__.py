"""Readers and writers of detections, beam results, waveforms and exports."""
