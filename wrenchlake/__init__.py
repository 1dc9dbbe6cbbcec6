"""Set-at-a-time analytics and change processing for a vehicle-service business."""
